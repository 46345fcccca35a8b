import pytest

from tactus.functions import lyrics
from tactus.operators import readings


@pytest.mark.parametrize(
    ("distances", "inferred", "want"),
    [
        ([], (), (0, "no-acoustic-evidence")),
        ([{"a": 1, "b": 1}, {"a": 0.5, "b": 0.4}], (), (1, "acoustic-agreement")),
        ([{"a": 1, "b": 1}, {"a": 0.9, "b": 0.95}], (), (0, "weak-evidence")),
        ([{"a": 1, "b": 1}, {"a": 0.2, "b": 1.2}], (), (0, "conflicting-evidence")),
        ([{"a": 1, "b": 1}, {"a": 1, "b": 1}], (), (0, "ambiguous-evidence")),
        ([{"a": 1, "b": 1}, {"a": 1, "b": 1}], ("x",), (1, "acoustic-over-inferred")),
        ([{"a": 0, "b": 0}, {"a": 1, "b": 1}], (), (0, "dictionary-supported")),
        ([{"a": 0.1}, {"a": 0.0}], (), (1, "acoustic-agreement")),
    ],
)
def test_select_reading(distances, inferred, want):
    assert readings.select_reading(["x", "y"], distances, frozenset(inferred)) == want


def test_select_readings(spark):
    c = spark.createDataFrame([("d", 0, 0, ["ハ", "シ"], False), ("d", 0, 1, ["キョ", "ウ"], False)], "doc_id string, line_index long, pos int, moras array<string>, inferred boolean")
    t = spark.createDataFrame([("d", 0, "mix", ["ア", "キョ", "ウ", "ワ"]), ("d", 0, "vocals", ["キョ", "ウ"])], "doc_id string, line_index long, view string, moras array<string>")
    got = readings.select_readings(c, t).first()
    assert (got.kana, got.reason, got.n_views) == ("キョウ", "acoustic-agreement", 2)


def test_phrase_repeats(spark):
    phrase = list("アオイソラ")
    events = [("d", k, o + 0.2 * i, o + 0.2 * i + 0.2) for o in (0.2, 2.2) for i, k in enumerate(phrase)]
    notes = [("d", 0.2 * i, 0.2 * i + 0.2) for i in range(20)]
    p = spark.createDataFrame([("d", 0, phrase)], "doc_id string, line_index long, moras array<string>")
    e = spark.createDataFrame(events, "doc_id string, kana string, start_sec double, end_sec double")
    n = spark.createDataFrame(notes, "doc_id string, start_sec double, end_sec double")
    got = readings.repeated_phrases(p, e, n).orderBy("start").collect()
    assert [(round(r.start, 3), r.kana, r.distance) for r in got] == [(0.2, "アオイソラ", 0.0), (2.2, "アオイソラ", 0.0)]


def test_normal_form_and_spans():
    assert lyrics.normalize("Ａｶﾞ\r\nか゛") == ("Aガ\nが", [(0, 1), (1, 3), (3, 5), (5, 7)])
    assert lyrics.normalize("いすゞヱ")[0] == "いすずエ"
    for bad in ("゛", "\x07", "漢ゝ", ""):
        with pytest.raises(lyrics.LyricError):
            lyrics.normalize(bad)


def test_parse(spark):
    df = spark.createDataFrame([("｜明日《あした》(ね)",), ("|x《y》",), (None,), ("\\(a)",)], "t string")
    got = [r[0] for r in df.select(lyrics.parse("t")).collect()]
    assert [(a.kind, a.start, a.end, a.reading) for a in got[0].annotations] == [("ruby", 0, 8, "アシタ"), ("parenthetical", 8, 11, None)]
    assert "kana" in got[1].error and got[2].text is None and got[3].annotations == []

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactus.functions import kana, sequences
from tactus.operators import decode, intervals, islands
from tactus.sources import scores
from tactus.streaming import sessions


def test_gap_equal_to_limit_joins(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 15, 20), ("a", 26, 30)], "k string, s long, e long")
    got = islands.bounds(islands.islands(df, "k", "s", "e", ["s"], 5), "k", "s", "e").orderBy("start").collect()
    assert [(r.start, r.end, r.n) for r in got] == [(0, 20, 2), (26, 30, 1)]


def test_subtract_against_points(spark):
    rng = random.Random(5)
    rows = [(1, i % 2, a := rng.randint(0, 80), a + rng.randint(1, 9)) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, side long, s long, e long")
    got = intervals.subtract(df.where("side = 0"), df.where("side = 1"), "k", "s", "e").collect()
    points = {p for r in got for p in range(r.start, r.end)}
    cover = lambda side: {p for _, d, s, e in rows if d == side for p in range(s, e)}
    assert points == cover(0) - cover(1)


def test_binned_join_is_the_join(spark):
    rng = random.Random(6)
    rows = [("x", i, a := rng.randint(0, 300), a + rng.randint(1, 60)) for i in range(60)]
    a = spark.createDataFrame(rows, "k string, i long, s long, e long")
    b = a.select("k", F.col("i").alias("j"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    pairs = lambda df: sorted((r.i, r.j) for r in df.select("i", "j").collect())
    assert pairs(intervals.binned_overlap_join(a, b, "k", ("s", "e"), ("s2", "e2"), 25)) == pairs(intervals.overlap_join(a, b, "k", ("s", "e"), ("s2", "e2")))


@pytest.mark.parametrize(("text", "want"), [("カーキャンッ", "カ ー キャ ン ッ"), ("ウォォォ", "ウォ ォ ォ"), ("アヵヶ", "ア ヵ ヶ")])
def test_moras(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(kana.moras(F.col("t"))).first()[0] == want.split()


def test_syllables_and_phonemes(spark):
    df = spark.createDataFrame([("シンシュンシャンソンショー",), ("カッ",)], "t string")
    assert [len(r[0]) for r in df.select(kana.syllables(F.col("t"))).collect()] == [5, 1]
    one = spark.createDataFrame([("キャーンッ",)], "t string")
    assert one.select(kana.phonemes(F.col("t"))).first()[0] == ["ky", "a", "a", "N", "q"]
    assert one.select(kana.vowels(F.col("t"))).first()[0] == ["a"]


def test_edit_costs():
    assert sequences.edit_cost(list("カキ"), list("カキ")) == 0
    assert sequences.edit_cost(list("カ"), list("サ")) == 1
    assert sequences.edit_cost(list("カ"), list("キ")) == 3
    assert sequences.edit_cost(list("bc"), list("abcd"), 1, 1, lambda x, y: float(x != y), True) == 0


def test_forced_alignment_is_the_best_path():
    rng = np.random.default_rng(2)
    for _ in range(20):
        scores_, targets = rng.normal(size=(6, 3)), list(rng.integers(1, 3, 2))

        def paths(f, s, acc, path):
            states = [0, targets[0], 0, targets[1], 0]
            if f == 6:
                if s >= 3:
                    yield acc, path
                return
            for n in range(s, min(s + 3, 5)):
                if n - s == 2 and (states[n] == 0 or states[n] == states[s]):
                    continue
                yield from paths(f + 1, n, acc + scores_[f, states[n]], [*path, n])

        best = max((p for s in (0, 1) for p in paths(1, s, scores_[0, [0, targets[0]][s]], [s])), key=lambda p: p[0])[1]
        want = [(best.index(k), len(best) - 1 - best[::-1].index(k)) for k in (1, 3)]
        assert sequences.forced_alignment(scores_, targets) == want


def test_decode_known_cases():
    note = lambda s, e, p=60: (s, e, p)
    assert decode.decode([0.0], [note(0, 0.2), note(0.2, 0.5), note(0.5, 0.8)])[1] == [("assign", 0, 0, 2)]
    assert decode.decode([0.0, 0.4], [note(0, 0.4), note(0.4, 0.8)])[1] == [("assign", 0, 0, 0), ("assign", 1, 1, 1)]
    assert decode.decode([0.0], [note(0, 0.3), note(0.3, 0.7, 62)])[1] == [("assign", 0, 0, 1)]
    cost, actions = decode.decode([None], [note(0, 0.3)])
    assert [a[0] for a in actions] == ["omit", "skip"] and cost == pytest.approx(0.7357166836930735 + 1.5 + 0.225)


def test_align_lines():
    same = lambda a, b: float(a == b)
    assert decode.align_lines(["アオイソラ"], ["アオイ", "ソラ"], same) == [([0], [0, 1])]
    assert decode.align_lines(["カキ", "サシ"], ["カキ", "タチ", "サシ"], same) == [([0], [0]), ([], [1]), ([1], [2])]


def test_writers(spark):
    cues = spark.createDataFrame([("d", 0, 1.0005, 2.5, "あ"), ("d", 1, 3.0, 3661.0, "い")], "doc_id string, line_index int, start_sec double, end_sec double, text string")
    assert scores.srt(cues).first()["srt"] == "1\n00:00:01,000 --> 00:00:02,500\nあ\n\n2\n00:00:03,000 --> 01:01:01,000\nい\n"
    assert scores.lrc(cues).first()["lrc"] == "[00:01.00]あ\n[00:03.00]い\n"
    data = scores.midi([(0.0, 0.5, 60, "カ", False), (0.5, 1.0, 62, "ー", True)])
    assert data[:4] == b"MThd" and data.count(b"\xff\x05") == 1 and data.endswith(b"\x00\xff\x2f\x00")
    xml = scores.musicxml([(0, 5000, 60, "カ", False)])
    assert xml.count("<measure ") == 2 and "<tie type=\"start\"/>" in xml and "<tie type=\"stop\"/>" in xml
    assert "Lyric=R" in scores.ust([(500, 1000, 60, "か")])


def test_readers(spark, tmp_path):
    (tmp_path / "a.lab").write_text("0.0 1.0 60\n0.9 1.5 62\n\n")
    rows = scores.read_lab(spark, str(tmp_path / "a.lab")).orderBy("start_sec").collect()
    assert [(r.start_sec, r.end_sec, r.midi_pitch) for r in rows] == [(0.0, 0.9, 60), (0.9, 1.5, 62)]
    (tmp_path / "b.lab").write_text("0.0 oops 60\n")
    with pytest.raises(Exception, match="bad melody row"):
        scores.read_lab(spark, str(tmp_path / "b.lab")).collect()
    (tmp_path / "d.json").write_text('{"a": 1, "b": 2}')
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.IntegerType())])
    assert "unexpected keys" in scores.read_documents(spark, str(tmp_path / "d.json"), schema).first()["error"]


def test_stream_is_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "ts").where("user_id < 10")
    far = events.selectExpr("-1L as event_id", "-1L as user_id", "cast('2100-01-01' as timestamp_ntz) as ts").limit(1)
    events.union(far).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = sessions.sessions(stream, "user_id", "ts", "1 hour", "1 day").writeStream.format("memory").queryName("runs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.user_id, r.start, r.end, r.n) for r in sessions.sessions(events, "user_id", "ts", "1 hour", "1 day").collect()}
    assert {tuple(r) for r in spark.table("runs").collect()} == want


def test_nearest_joins_against_all_pairs(spark):
    rng = random.Random(8)
    points = [(k, i, rng.randint(0, 60)) for i, k in enumerate(rng.choice("ab") for _ in range(60))] + [("c", 99, 5), (None, 98, 5), ("a", 97, None)]
    owners, at = [], {"a": 0, "b": 3}
    for i in range(14):
        k = rng.choice("ab")
        start = at[k] + rng.randint(1, 4)
        at[k] = start + rng.randint(0, 5)
        owners.append((k, start, at[k], i))
    p = spark.createDataFrame(points, "k string, i long, t long")
    o = spark.createDataFrame(owners, "k string, s long, e long, o long")
    got = {r.i: (r.o, r.distance) for r in intervals.nearest_owner(p.where("t is not null"), o, "k", "i", "t", "s", "e", "o").collect()}
    want = {}
    for k, i, t in points:
        found = [(max(0, s - t, t - e), s, n) for q, s, e, n in owners if q == k] if t is not None else []
        if found:
            want[i] = (min(found)[2], min(found)[0])
    assert got == want
    near = {i for k, i, t in points if t is not None and any(q == k and abs(s - t) <= 3 for q, s, _, _ in owners)}
    others = o.select("k", "s")
    assert {r.i for r in intervals.within(p, others, "k", "t", "s", 3).collect()} == near
    assert {r.i for r in intervals.within(p, others, "k", "t", "s", 3, "left_anti").collect()} == {i for _, i, _ in points} - near


def test_prefix_costs_against_the_whole_table():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.choice("アイカキサコ") for _ in range(rng.randint(0, n))] for n in (5, 7))
        got = sequences.prefix_costs(a, b)
        for j in range(len(b) + 1):
            part = b[:j]
            best = {(0, 0): (0.0, 0)}
            for x in range(len(a) + 1):
                for y in range(j + 1):
                    options = [best[x, y]] if (x, y) in best and x == y == 0 else []
                    if x:
                        options.append((best[x - 1, y][0] + 1, best[x - 1, y][1]))
                    if y:
                        options.append((best[x, y - 1][0] + 1, best[x, y - 1][1]))
                    if x and y:
                        c, m = best[x - 1, y - 1]
                        same = a[x - 1] == part[y - 1]
                        vowel = sequences._SOUND[a[x - 1]][1] == sequences._SOUND[part[y - 1]][1]
                        options.append((c + (0 if same else 0.5 if vowel else 1), m - same))
                    best[x, y] = min(options)
            assert got[j] == (best[len(a), j][0], -best[len(a), j][1])

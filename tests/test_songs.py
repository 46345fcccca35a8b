from pyspark.sql import functions as F

from tactus.operators import observations, songs

NOTES = "doc_id string, pos int, start_sec double, end_sec double, midi_pitch int"
LINES = "doc_id string, line_index int, text string, start_sec double, end_sec double"


def notes(spark, times):
    return spark.createDataFrame([("d", i, float(s), float(e), 60) for i, (s, e) in enumerate(times)], NOTES)


def test_melodic_support(spark):
    lines = spark.createDataFrame([("d", 0, "あいうえ", 0.0, 2.0), ("d", 1, "あいうえ", 4.0, 6.0), ("d", 2, "x", None, None)], LINES)
    got = {r.line_index: r.melodic for r in songs.melodic_support(lines, notes(spark, [(1.7, 2.2), (4.0, 4.1)])).collect()}
    assert got == {0: True, 1: False, 2: False}


def test_uncovered_windows(spark):
    lines = spark.createDataFrame([("d", 0, "a", 0.0, 1.0), ("d", 1, "b", 5.0, 6.0)], LINES)
    free = [(2 + 0.4 * i, 2.3 + 0.4 * i) for i in range(6)]
    got = [(round(r.start, 3), round(r.end, 3)) for r in songs.uncovered_windows(lines, notes(spark, [(0.5, 0.9), *free])).collect()]
    assert got == [(1.7, 4.6)]


def test_singing_islands(spark):
    lines = spark.createDataFrame([("d", 0, "credit", 0.0, 10.0)], LINES)
    got = songs.singing_islands(lines, notes(spark, [(0.5, 1.5), (2.0, 3.0), (6.0, 6.4)])).collect()
    assert [(r.start, r.end) for r in got] == [(0.5, 3.0)]


def test_deficit_windows(spark):
    lines = spark.createDataFrame([("d", 0, "a", 0.0, 4.0), ("d", 1, "b", 4.0, 8.0)], LINES)
    units = spark.createDataFrame([("d", 0, 4), ("d", 1, 8)], "doc_id string, line_index int, n int")
    dense = [(0.4 * i, 0.4 * i + 0.35) for i in range(10)]
    got = songs.deficit_windows(lines, notes(spark, [*dense, (4.5, 5.0), (5.5, 6.0)]), units).collect()
    assert [(r.line_index, r.start) for r in got] == [(0, 0.0)] and abs(got[0].end - 4.0) < 1e-9


def test_vocal_activity(spark):
    frames = spark.createDataFrame([("d", i, 0.5 if i < 20 else 0.0) for i in range(40)], "doc_id string, frame_idx int, rms double")
    windows = spark.createDataFrame([("d", 0.0, 1.0), ("d", 1.0, 2.0), ("d", 1.0, 9.0)], "doc_id string, start_sec double, end_sec double")
    got = {(r.start_sec, r.end_sec): r for r in songs.vocal_activity(frames, windows).collect()}
    assert got[0.0, 1.0].supported and got[0.0, 1.0].silence_confirmed is False and got[0.0, 1.0].active_frame_ratio == 1
    assert not got[1.0, 2.0].supported and got[1.0, 2.0].silence_confirmed is True
    assert got[1.0, 9.0].silence_confirmed is None


def test_split_interval(spark):
    rows = [("d", "s", i, 0.0, 4.0, o, w) for i, (o, w) in enumerate([(None, 1), (1.0, 1), (None, 2), (3.0, 1), (2.0, 1)])]
    df = spark.createDataFrame(rows, "doc_id string, slot_id string, pos int, start_sec double, end_sec double, onset double, weight int")
    got = [(round(r.part_start, 6), round(r.part_end, 6), r.timing) for r in songs.split_interval(df).orderBy("pos").collect()]
    assert got == [(0, 1, "aligned_boundary"), (1, round(5 / 3, 6), "proportional_fallback"), (round(5 / 3, 6), 3, "proportional_fallback"), (3, 3.5, "proportional_fallback"), (3.5, 4, "proportional_fallback")]


def test_slots_and_mora_times(spark):
    units = spark.createDataFrame([("d", "u0", "l", 0, "カ", None), ("d", "u1", "l", 1, "キャン", 2.0)], "doc_id string, unit_id string, utterance_id string, pos int, kana string, release_sec double")
    links = spark.createDataFrame([("d", "u0", 0), ("d", "u0", 1), ("d", "u1", 2)], "doc_id string, unit_id string, note_pos int")
    got = songs.slots(links, notes(spark, [(0, 0.6), (0.5, 0.8), (1, 1.5)]), units).orderBy("start_sec")
    assert [(r.kana, r.start_sec, r.end_sec, r.continuation) for r in got.collect()] == [("カ", 0.0, 0.5, False), ("ー", 0.5, 0.8, True), ("キャン", 1.0, 2.0, False)]
    times = songs.mora_times(got, units).orderBy("start_sec").collect()
    assert [(r.kana, r.start_sec, r.end_sec) for r in times] == [("カ", 0.0, 0.8), ("キャ", 1.0, 1.5), ("ン", 1.5, 2.0)]


def test_repeated_unit_and_foreign_text(spark):
    df = spark.createDataFrame([(["ラ", "ラ"], "la la"), (["ラ", "リ"] * 3, "hello 世"), (["ラ", "リ"] * 2, "ab 世界"), (["ラ"], "")], "m array<string>, t string")
    got = df.select(songs.repeated_unit(F.col("m")).alias("u"), songs.foreign_text(F.col("t")).alias("f")).collect()
    assert [r.u for r in got] == [["ラ"], ["ラ", "リ"], None, None] and [r.f for r in got] == [True, True, False, False]


DOC = """doc_id string, canonical_text string,
utterances array<struct<id:string,surface:string,surface_span:struct<start:int,end:int>,reading_candidate_ids:array<string>,selected_reading_id:string>>,
readings array<struct<id:string,utterance_id:string,kana:string,score:double,mora_ids:array<string>>>,
moras array<struct<id:string,text:string,singing_unit_ids:array<string>>>,
singing_units array<struct<id:string,mora_ids:array<string>,status:string,confidence:double,consonant_start:struct<time_sec:double>,consonant_end:struct<time_sec:double>>>,
note_candidates array<struct<id:string,start_sec:double,end_sec:double,midi_pitch:int,confidence:double,sources:array<string>>>,
links array<struct<id:string,singing_unit_ids:array<string>,note_candidate_ids:array<string>,operation:string,cost:double,cost_components:struct<ctc_anchor_timing:double,candidate_confidence:double,complexity:double>>>"""


def test_observation_rules(spark):
    def doc(name, text="蚊", kana="カ", status="observed", pitch=60, operation="match", cost=0.5, unit="s0"):
        return (name, text, [("u0", "蚊", (0, 1), ["r0"], "r0")], [("r0", "u0", kana, 1.0, ["m0"])], [("m0", "カ", [unit])], [("s0", ["m0"], status, 0.9, (0.1,), (0.4,))], [("n0", 0.1, 0.4, pitch, 0.8, ["x"])], [("k0", ["s0"], ["n0"], operation, cost, (0.2, 0.2, 0.1))])

    docs = spark.createDataFrame([doc("good"), doc("text", text="火"), doc("kana", kana="キ"), doc("status", status="unobserved"), doc("pitch", pitch=200), doc("arity", operation="stack"), doc("cost", cost=0.6), doc("unit", unit="s9")], DOC)
    got = {}
    for r in observations.violations(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.rule.split()[0])
    assert got == {"text": {"V7"}, "kana": {"V9"}, "status": {"V12"}, "pitch": {"V14"}, "arity": {"V15"}, "cost": {"V16"}, "unit": {"V3", "V11"}}

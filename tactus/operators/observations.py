"""Integrity rules of nested song documents: rows (doc_id, rule, owner, detail), empty for a valid document.

A document is one row with arrays of structs: utterances (id, surface, surface_span, reading_candidate_ids,
selected_reading_id), readings (id, utterance_id, kana, score, mora_ids), moras (id, text, singing_unit_ids), singing_units (id,
mora_ids, status, confidence, consonant_start, consonant_end), note_candidates (id, start_sec, end_sec, midi_pitch, confidence,
sources), links (id, singing_unit_ids, note_candidate_ids, operation, cost, cost_components) and canonical_text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITIES = ("utterances", "readings", "moras", "singing_units", "note_candidates", "links")
#: Numbers of units and notes that an operation takes: least and most of each, null for no limit. Fixed values.
ARITY = {"match": (1, 1, 1, 1), "melisma": (1, 1, 2, None), "stack": (2, None, 1, 1), "sokuon": (2, 2, 1, None), "note_only": (0, 0, 1, 1), "unit_only": (1, 1, 0, 0), "rest": (0, 0, 1, 1)}


def entity(docs: DataFrame, name: str) -> DataFrame:
    return docs.select("doc_id", "canonical_text", F.explode(name).alias("x")).select("doc_id", "canonical_text", "x.*")


def _bad(df: DataFrame, rule: str, condition: Column, detail: Column | None = None) -> DataFrame:
    found = df.where(F.coalesce(condition, F.lit(True)))
    return found.select("doc_id", F.lit(rule).alias("rule"), F.col("id").alias("owner"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))


def _references(docs: DataFrame, rule: str, owner: str, column: str, target: str) -> list[DataFrame]:
    rows = entity(docs, owner)
    known = entity(docs, target).select("doc_id", F.col("id").alias("_ref"))
    lost = rows.select("doc_id", "id", F.explode(column).alias("_ref")).join(known, ["doc_id", "_ref"], "left_anti")
    return [_bad(lost, f"{rule} unknown {column}", F.lit(True), F.col("_ref")), _bad(rows, f"{rule} repeated {column}", F.size(F.array_distinct(column)) != F.size(column))]


def _fraction(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0) | (F.col(c) > 1)


def violations(docs: DataFrame) -> DataFrame:
    ids = reduce(DataFrame.union, [entity(docs, e).select("doc_id", "id") for e in ENTITIES])
    twice = ids.groupBy("doc_id", "id").count().where("count > 1 or id is null or id = ''")
    u, r, m, s, n, l = (entity(docs, e) for e in ENTITIES)
    start, end = F.col("surface_span.start"), F.col("surface_span.end")
    out = [_bad(twice, "V2 ids", F.lit(True), F.col("count"))]
    out += _references(docs, "V3", "utterances", "reading_candidate_ids", "readings")
    out += _references(docs, "V3", "readings", "mora_ids", "moras")
    out += _references(docs, "V3", "moras", "singing_unit_ids", "singing_units")
    out += _references(docs, "V3", "singing_units", "mora_ids", "moras")
    out += _references(docs, "V3", "links", "singing_unit_ids", "singing_units")
    out += _references(docs, "V3", "links", "note_candidate_ids", "note_candidates")
    out += [_bad(x, "V4 fraction", _fraction(c)) for x, c in ((r, "score"), (s, "confidence"), (n, "confidence"))]
    out.append(_bad(u, "V7 span", (start < 0) | (end > F.length("canonical_text")) | (F.substring("canonical_text", start + 1, end - start) != F.col("surface"))))
    out.append(_bad(u, "V8 selected", ~F.array_contains("reading_candidate_ids", F.col("selected_reading_id"))))
    texts = r.select("doc_id", "id", "kana", F.posexplode("mora_ids").alias("k", "_m")).join(m.select("doc_id", F.col("id").alias("_m"), "text"), ["doc_id", "_m"])
    spelled = texts.groupBy("doc_id", "id", "kana").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "").alias("spelled"))
    out.append(_bad(spelled, "V9 spelling", F.col("spelled") != F.col("kana"), F.col("spelled")))
    edges = [m.select("doc_id", F.explode("singing_unit_ids").alias("unit"), F.col("id").alias("mora")), s.select("doc_id", F.col("id").alias("unit"), F.explode("mora_ids").alias("mora"))]
    for a, b in (edges, edges[::-1]):
        out.append(_bad(a.exceptAll(b).withColumnRenamed("unit", "id"), "V11 reciprocal", F.lit(True), F.col("mora")))
    begin, stop = F.col("consonant_start.time_sec"), F.col("consonant_end.time_sec")
    hidden = (F.col("confidence") != 0) | begin.isNotNull() | stop.isNotNull()
    out.append(_bad(s, "V12 boundaries", ~F.col("status").isin("observed", "weak", "unobserved") | F.when(F.col("status") == "unobserved", hidden).otherwise(begin.isNull() | stop.isNull() | (stop <= begin))))
    pitch = F.col("midi_pitch")
    out.append(_bad(n, "V14 note", (F.col("start_sec") < 0) | (F.col("end_sec") <= F.col("start_sec")) | (F.size("sources") == 0) | F.coalesce((pitch < 0) | (pitch > 127), F.lit(False))))
    a, b, fits = F.size("singing_unit_ids"), F.size("note_candidate_ids"), F.lit(False)
    for name, (a0, a1, b0, b1) in ARITY.items():
        ok = (F.col("operation") == name) & (a >= a0) & (b >= b0)
        fits |= ok & (a <= a1 if a1 is not None else F.lit(True)) & (b <= b1 if b1 is not None else F.lit(True))
    out.append(_bad(l, "V15 arity", ~fits, F.col("operation")))
    parts = [F.col(f"cost_components.{c}") for c in ("ctc_anchor_timing", "candidate_confidence", "complexity")]
    total = reduce(lambda x, y: x + y, parts)
    out.append(_bad(l, "V16 cost", (F.abs(F.col("cost") - total) > 1e-9) | reduce(lambda x, y: x | y, [p < 0 for p in parts])))
    return reduce(DataFrame.union, out)

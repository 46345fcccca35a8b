"""Operators on song tables, keyed by doc_id: gates, retry windows, activity of a voice, units, slots and mora times.

lines (doc_id, line_index, text, start_sec, end_sec); notes (doc_id, pos, start_sec, end_sec, midi_pitch); moras (doc_id,
line_index, mora_index, kana, start_sec, end_sec, confidence); frames (doc_id, frame_idx, rms). Unknown times are null and match
nothing. Limits are fixed values, in seconds unless their name says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kana
from . import islands

USABLE, CONFIDENT = 1e-5, 7.5e-4


def usable(time: Column, confidence: Column) -> Column:
    """A boundary that was measured."""
    return time.isNotNull() & F.coalesce(confidence >= USABLE, F.lit(False))


def line_notes(lines: DataFrame, notes: DataFrame) -> DataFrame:
    """Pairs of lines and notes that overlap, both strictly, with the length they share."""
    n = notes.select("doc_id", F.col("start_sec").alias("n_start"), F.col("end_sec").alias("n_end"))
    met = lines.join(n, "doc_id").where("start_sec < n_end and end_sec > n_start")
    return met.withColumn("shared", F.least("end_sec", "n_end") - F.greatest("start_sec", "n_start"))


def melodic_support(lines: DataFrame, notes: DataFrame) -> DataFrame:
    """lines with `melodic`: notes cover the lesser of a quarter of the line and 0.05 s a character, and that is not zero."""
    covered = line_notes(lines, notes).groupBy("doc_id", "line_index").agg(F.sum("shared").alias("_covered"))
    need = F.least(F.greatest(F.lit(0.0), F.col("end_sec") - F.col("start_sec")) * 0.25, F.length(F.trim(kana.nfkc("text"))) * 0.05)
    rows = lines.join(covered, ["doc_id", "line_index"], "left")
    return rows.withColumn("melodic", F.coalesce((need > 0) & (F.coalesce("_covered", F.lit(0.0)) >= need), F.lit(False))).drop("_covered")


def confidence_gate(lines: DataFrame, moras: DataFrame, notes: DataFrame, template: Column) -> DataFrame:
    """lines with `rejected`: a template whose median mora confidence is too low and that no melody supports."""
    medians = moras.groupBy("doc_id", "line_index").agg(F.median("confidence").alias("_median"))
    rows = melodic_support(lines, notes).join(medians, ["doc_id", "line_index"], "left")
    return rows.withColumn("rejected", F.coalesce(template & (F.col("_median") < CONFIDENT) & ~F.col("melodic"), F.lit(False))).drop("_median")


def verified(moras: DataFrame) -> DataFrame:
    """Rows (doc_id, line_index, quality, verified): the geometric mean of confidences, and whether it and the least suffice."""
    quality = F.exp(F.avg(F.log(F.greatest("confidence", F.lit(1e-30)))))
    return moras.groupBy("doc_id", "line_index").agg(quality.alias("quality"), F.coalesce((F.min("confidence") >= USABLE) & (quality >= CONFIDENT), F.lit(False)).alias("verified"))


def uncovered_windows(lines: DataFrame, notes: DataFrame, gap: float = 0.35, least: int = 5, shortest: float = 1.5, longest: float = 20.0, most: int = 4) -> DataFrame:
    """The first windows of each song where many notes meet no line: (doc_id, rank, start, end), widened by 0.3 between lines."""
    timed = lines.where("start_sec is not null and end_sec is not null").select("doc_id", F.col("start_sec").alias("l_start"), F.col("end_sec").alias("l_end"))
    meets = (notes["doc_id"] == timed["doc_id"]) & (F.col("l_start") < F.col("end_sec")) & (F.col("l_end") > F.col("start_sec"))
    free = notes.join(timed, meets, "left_anti")
    w = Window.partitionBy("doc_id").orderBy("start_sec", "pos")
    free = free.withColumn("before", F.lag("end_sec").over(w))
    between = free.alias("f").join(timed.alias("t"), (F.col("f.doc_id") == F.col("t.doc_id")) & (F.col("l_start") < F.col("start_sec")) & (F.col("l_end") > F.col("before")), "left_semi").select("doc_id", "pos", F.lit(True).alias("crosses"))
    free = free.join(between.distinct(), ["doc_id", "pos"], "left")
    new = F.col("before").isNull() | (F.col("start_sec") - F.col("before") > gap) | F.coalesce("crosses", F.lit(False))
    runs = free.withColumn("run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy("doc_id", "run").agg(F.min("start_sec").alias("start"), F.max_by("end_sec", F.struct("start_sec", "pos")).alias("end"), F.count("*").alias("n"))
    runs = runs.where((F.col("n") >= least) & (F.col("end") - F.col("start")).between(shortest, longest))
    near = runs.join(timed, "doc_id", "left").groupBy("doc_id", "run", "start", "end").agg(
        F.coalesce(F.max(F.when(F.col("l_end") <= F.col("start"), F.col("l_end"))), F.lit(0.0)).alias("left"),
        F.min(F.when(F.col("l_start") >= F.col("end"), F.col("l_start"))).alias("right"),
    )
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("start"))
    return near.select("doc_id", rank.alias("rank"), F.greatest("left", F.col("start") - 0.3).alias("start"), F.least(F.coalesce("right", F.col("end") + 0.3), F.col("end") + 0.3).alias("end")).where(F.col("rank") <= most)


def singing_islands(lines: DataFrame, notes: DataFrame, gap: float = 1.0, shortest: float = 1.5, melody: float = 0.5) -> DataFrame:
    """Stretches of a line with singing: (doc_id, line_index, start, end); notes are clipped to the line and bridged by `gap`."""
    clipped = line_notes(lines, notes).select("doc_id", "line_index", F.greatest("start_sec", "n_start").alias("s"), F.least("end_sec", "n_end").alias("e"))
    keys = ["doc_id", "line_index"]
    runs = islands.islands(clipped, keys, "s", "e", ["s", "e"], gap)
    before = Window.partitionBy(*keys, "island").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    sung = F.greatest(F.lit(0.0), F.col("e") - F.greatest(F.col("s"), F.coalesce(F.max("e").over(before), F.col("s"))))
    found = runs.withColumn("sung", sung).groupBy(*keys, "island").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.sum("sung").alias("sung"))
    return found.where((F.col("end") - F.col("start") >= shortest) & (F.col("sung") >= melody)).select(*keys, "start", "end")


def deficit_windows(lines: DataFrame, notes: DataFrame, units: DataFrame) -> DataFrame:
    """Note-rich stretches of lines with too little text for their song: (doc_id, line_index, start, end).

    units (doc_id, line_index, n): moras and Latin words of a line. A line counts if it has 7 notes, 1.5 notes a unit and 4 more
    notes than the song's median ratio gives it; its note runs by gaps of 0.32, of 4 notes and 0.6 s at least, widen by 0.5 up to
    the line's ends and the middle of the gap to the next such run.
    """
    keys = ["doc_id", "line_index"]
    n = notes.select("doc_id", "pos", F.col("start_sec").alias("n_start"), F.col("end_sec").alias("n_end"))
    held = lines.join(n, "doc_id").where((F.col("n_start") + F.col("n_end")) / 2 >= F.col("start_sec")).where((F.col("n_start") + F.col("n_end")) / 2 < F.col("end_sec"))
    counted = units.join(held.groupBy(*keys).agg(F.count("*").alias("found")), keys)
    medians = counted.where("n >= 4 and found >= 2").groupBy("doc_id").agg(F.median(F.col("found") / F.col("n")).alias("median"))
    rich = counted.join(medians, "doc_id").where((F.col("found") >= 7) & (F.col("found") >= 1.5 * F.greatest("n", F.lit(1))) & (F.col("found") - F.col("median") * F.col("n") >= 4))
    inside = held.join(rich.select(*keys), keys, "left_semi")
    w = Window.partitionBy(*keys).orderBy("n_start", "pos")
    new = F.lag("n_end").over(w).isNull() | (F.col("n_start") - F.lag("n_end").over(w) > 0.32)
    runs = inside.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy(*keys, "run", "start_sec", "end_sec").agg(F.min("n_start").alias("s"), F.max_by("n_end", F.struct("n_start", "pos")).alias("e"), F.count("*").alias("k")).where((F.col("k") >= 4) & (F.col("e") - F.col("s") >= 0.6))
    order = Window.partitionBy(*keys).orderBy("s")
    start = F.greatest("start_sec", F.col("s") - 0.5, F.coalesce((F.lag("e").over(order) + F.col("s")) / 2, F.col("start_sec")))
    end = F.least("end_sec", F.col("e") + 0.5, F.coalesce((F.col("e") + F.lead("s").over(order)) / 2, F.col("end_sec")))
    return runs.select(*keys, start.alias("start"), end.alias("end")).where("end > start")


def vocal_activity(frames: DataFrame, windows: DataFrame, frame_sec: float = 0.05) -> DataFrame:
    """windows (doc_id, start_sec, end_sec) with the level of a voice, relative to its song.

    Levels are dBFS of whole frames, -240 at least. The reference is the 90th percentile of the song's frames from -70 on, of all
    if there are none; a window is supported if its own 90th percentile reaches 30 below, and -70. silence_confirmed is null
    where the window is not within the song.
    """
    levels = frames.select("doc_id", "frame_idx", F.greatest(F.lit(-240.0), 20 * F.log10(F.greatest("rms", F.lit(1e-12)))).alias("db"))
    song = levels.groupBy("doc_id").agg(F.coalesce(F.percentile(F.when(F.col("db") >= -70, F.col("db")), 0.9), F.percentile("db", 0.9)).alias("reference"), ((F.max("frame_idx") + 1) * frame_sec).alias("length"))
    song = song.withColumn("floor", F.greatest(F.lit(-70.0), F.col("reference") - 30))
    at = levels.select(F.col("doc_id").alias("_d"), (F.col("frame_idx") * frame_sec).alias("_t"), "db")
    met = windows.join(song, "doc_id").join(at, (F.col("doc_id") == F.col("_d")) & (F.col("_t") >= F.col("start_sec") - 1e-9) & (F.col("_t") < F.col("end_sec") - 1e-9), "left")
    own = F.col("db")
    out = met.groupBy("doc_id", "start_sec", "end_sec", "reference", "floor", "length").agg(F.coalesce(F.percentile(own, 0.9), F.lit(-240.0)).alias("percentile_dbfs"), F.coalesce(F.avg((own >= F.col("floor")).cast("double")), F.lit(0.0)).alias("active_frame_ratio"), F.bool_and(own < -70).alias("quiet"), F.count(own).alias("n"))
    covered = (F.col("n") > 0) & (F.col("start_sec") >= 0) & (F.col("start_sec") < F.col("end_sec")) & (F.col("end_sec") <= F.col("length") + 1e-9)
    return out.select("doc_id", "start_sec", "end_sec", "percentile_dbfs", (F.col("percentile_dbfs") - F.col("reference")).alias("relative_db"), "active_frame_ratio", (F.col("percentile_dbfs") >= F.col("floor")).alias("supported"), F.when(covered, F.col("quiet")).alias("silence_confirmed"))


def foreign_text(text: Column) -> Column:
    """At least four ASCII letters, and they are half of all letters."""
    ascii_letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return (ascii_letters >= 4) & (ascii_letters * 2 >= F.length(F.regexp_replace(text, r"\P{L}", "")))


def phonetic_cover(events: DataFrame, notes: DataFrame, reach: float = 0.12) -> DataFrame:
    """Events that overlap a note widened by `reach`."""
    n = notes.select("doc_id", F.col("start_sec").alias("n_start"), F.col("end_sec").alias("n_end"))
    on = (events["doc_id"] == n["doc_id"]) & (events["start_sec"] < F.col("n_end") + reach) & (events["end_sec"] > F.col("n_start") - reach)
    return events.join(n, on, "left_semi")


def split_interval(units: DataFrame) -> DataFrame:
    """Share an interval among its units in order: (…, part_start, part_end, timing).

    units (doc_id, slot_id, pos, start_sec, end_sec, onset, weight). Onsets that grow inside the interval are anchors; between two
    anchors units get time by weight, at least 1. timing: aligned_boundary between two anchors, note_interval for a single
    unit, else proportional_fallback.
    """
    keys = ["doc_id", "slot_id"]
    w = Window.partitionBy(*keys).orderBy("pos")
    all_rows = Window.partitionBy(*keys)
    before = F.max(F.when((F.col("_n") > 1) & (F.col("onset") < F.col("end_sec")), F.col("onset"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = units.withColumn("_n", F.row_number().over(w)).withColumn("weight", F.greatest("weight", F.lit(1)))
    rows = rows.withColumn("_last", F.greatest("start_sec", F.coalesce(before, F.col("start_sec"))))
    anchor = F.when(F.col("_n") == 1, F.col("start_sec")).when((F.col("onset") > F.col("_last")) & (F.col("onset") < F.col("end_sec")), F.col("onset"))
    rows = rows.withColumn("_anchor", anchor).withColumn("_group", F.count("_anchor").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    group = Window.partitionBy(*keys, "_group")
    rows = rows.withColumn("_from", F.max("_anchor").over(group))
    rows = rows.withColumn("_to", F.coalesce(F.min(F.when(F.col("_anchor").isNotNull(), F.col("_anchor"))).over(w.rowsBetween(1, Window.unboundedFollowing)), F.col("end_sec")))
    through = F.sum("weight").over(group.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total, length = F.sum("weight").over(group), F.col("_to") - F.col("_from")
    timing = F.when(F.count("*").over(all_rows) == 1, "note_interval").when(F.count("*").over(group) == 1, "aligned_boundary").otherwise("proportional_fallback")
    out = rows.withColumn("part_start", F.col("_from") + length * (through - F.col("weight")) / total).withColumn("part_end", F.col("_from") + length * through / total).withColumn("timing", timing)
    return out.drop("_n", "_last", "_anchor", "_group", "_from", "_to")


def slots(links: DataFrame, notes: DataFrame, units: DataFrame) -> DataFrame:
    """Slots of a score: (doc_id, unit_id, utterance_id, pos, kana, start_sec, end_sec, midi_pitch, continuation).

    links (doc_id, unit_id, note_pos); units (doc_id, unit_id, utterance_id, pos, kana, release_sec). Notes end at the next
    different start; a unit's later notes are continuations with a long mark; the last slot of an utterance goes on to the
    unit's measured release, at most to the next slot.
    """
    rows = links.join(units, ["doc_id", "unit_id"]).join(notes.select("doc_id", F.col("pos").alias("note_pos"), "start_sec", "end_sec", "midi_pitch"), ["doc_id", "note_pos"])
    nexts = Window.partitionBy("doc_id").orderBy("start_sec").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("_later", F.array_min(F.filter(F.collect_set("start_sec").over(nexts), lambda s: s > F.col("start_sec"))))
    rows = rows.withColumn("end_sec", F.least("end_sec", F.coalesce("_later", F.col("end_sec")))).drop("_later")
    nth = F.row_number().over(Window.partitionBy("doc_id", "unit_id").orderBy("start_sec", "note_pos"))
    rows = rows.withColumn("continuation", nth > 1).withColumn("kana", F.when(nth > 1, F.lit("ー")).otherwise(F.col("kana")))
    w = Window.partitionBy("doc_id").orderBy("start_sec", "pos", "note_pos")
    last = ~F.col("utterance_id").eqNullSafe(F.lead("utterance_id").over(w))
    reach = F.least("release_sec", F.coalesce(F.lead("start_sec").over(w), F.col("release_sec")))
    rows = rows.withColumn("end_sec", F.when(last & (reach > F.col("end_sec") + 1e-9), reach).otherwise(F.col("end_sec")))
    return rows.select("doc_id", "unit_id", "utterance_id", "pos", "kana", "start_sec", "end_sec", "midi_pitch", "continuation")


def mora_times(slot_rows: DataFrame, units: DataFrame) -> DataFrame:
    """Every mora's share of its unit's time, in equal parts: (doc_id, unit_id, mora_index, kana, start_sec, end_sec)."""
    spans = slot_rows.groupBy("doc_id", "unit_id").agg(F.min("start_sec").alias("s"), F.max("end_sec").alias("e"))
    parts = units.join(spans, ["doc_id", "unit_id"]).withColumn("m", kana.moras(F.col("kana")))
    rows = parts.select("doc_id", "unit_id", "s", "e", F.size("m").alias("n"), F.posexplode("m").alias("mora_index", "kana"))
    step = (F.col("e") - F.col("s")) / F.col("n")
    return rows.select("doc_id", "unit_id", "mora_index", "kana", (F.col("s") + step * F.col("mora_index")).alias("start_sec"), (F.col("s") + step * (F.col("mora_index") + 1)).alias("end_sec"))


def repeated_unit(moras: Column, longest: int = 3) -> Column:
    """The shortest period, up to `longest`, that an array of moras repeats: twice if of one mora, else three times; else null."""
    def fits(width: int) -> Column:
        enough = F.size(moras) >= (2 * width if width == 1 else 3 * width)
        return enough & F.forall(F.sequence(F.lit(0), F.size(moras) - 1), lambda i: F.get(moras, i) == F.get(moras, i % width))

    out = F.lit(None).cast("array<string>")
    for width in range(longest, 0, -1):
        out = F.when(fits(width), F.slice(moras, 1, width)).otherwise(out)
    return out

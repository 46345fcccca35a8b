"""Readers and writers of scores: melody tables, strict JSON documents, subtitles, MIDI, MusicXML and UST."""

from __future__ import annotations

import json
import struct
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_lab(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, start_sec, end_sec, midi_pitch) of three-column text; ends are clipped to the next start.

    A line that is not two growing times and a pitch, and two notes with one start, raise an error.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.split(F.trim("value"), r"\s+").alias("p")).where(F.element_at("p", 1) != "")
    start, end, pitch = (F.try_element_at("p", F.lit(i)).try_cast("double") for i in (1, 2, 3))
    good = (F.size("p") == 3) & start.isNotNull() & (end > start) & (start >= 0) & pitch.between(0, 127)
    rows = lines.select("path", F.when(F.coalesce(good, F.lit(False)), start).otherwise(F.raise_error(F.concat(F.lit("bad melody row: "), F.array_join("p", " ")))).alias("start_sec"), end.alias("end_sec"), pitch.cast("int").alias("midi_pitch"))
    after = F.lead("start_sec").over(Window.partitionBy("path").orderBy("start_sec"))
    clear = F.when(after == F.col("start_sec"), F.raise_error(F.lit("two notes with one start"))).otherwise(F.least("end_sec", F.coalesce(after, F.col("end_sec"))))
    return rows.withColumn("end_sec", clear)


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows (path, doc, error) of whole JSON files; other keys at the root than the schema's are an error, not ignored."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    keys = F.array_sort(F.json_object_keys("value"))
    doc = F.from_json("value", schema)
    error = F.when(keys.isNull(), "not a JSON object").when(keys != F.array(*map(F.lit, sorted(schema.names))), F.concat(F.lit("unexpected keys: "), F.array_join(keys, ",")))
    return raw.select("path", F.when(error.isNull(), doc).alias("doc"), error.alias("error"))


def dump_document(doc: dict) -> str:
    """Deterministic JSON: sorted keys, no escapes of letters, a final line feed; NaN is an error."""
    return json.dumps(doc, ensure_ascii=False, sort_keys=True, indent=2, allow_nan=False) + "\n"


def stamp(seconds: Column, srt: bool) -> Column:
    """HH:MM:SS,mmm or MM:SS.cc; milliseconds round half to even and are at least 0."""
    ms = F.greatest(F.bround(seconds * 1000).cast("long"), F.lit(0).cast("long"))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    minutes = F.floor(ms / 60000)
    long = lambda x: F.when(x < 100, two(x)).otherwise(x.cast("string"))
    seconds_part = two(F.floor(ms / 1000) % 60)
    if srt:
        return F.concat(long(F.floor(minutes / 60)), F.lit(":"), two(minutes % 60), F.lit(":"), seconds_part, F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))
    return F.concat(long(minutes), F.lit(":"), seconds_part, F.lit("."), two(F.floor(ms / 10) % 100))


def cues(slots: DataFrame, lines: DataFrame, line: str = "line_index") -> DataFrame:
    """First start and last end of every line that has slots."""
    return slots.groupBy("doc_id", line).agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec")).join(lines.select("doc_id", line, "text"), ["doc_id", line])


def srt(cue_rows: DataFrame) -> DataFrame:
    """Rows (doc_id, srt)."""
    w = Window.partitionBy("doc_id").orderBy("start_sec", "end_sec", "text")
    rows = cue_rows.withColumn("n", F.row_number().over(w))
    block = F.concat_ws("\n", F.col("n").cast("string"), F.concat_ws(" --> ", stamp(F.col("start_sec"), True), stamp(F.col("end_sec"), True)), "text")
    return rows.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n\n"), F.lit("\n")).alias("srt"))


def lrc(cue_rows: DataFrame) -> DataFrame:
    """Rows (doc_id, lrc)."""
    line = F.concat(F.lit("["), stamp(F.col("start_sec"), False), F.lit("]"), F.col("text"))
    return cue_rows.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_sec", "end_sec", "text", line.alias("l")))), lambda x: x["l"]), "\n"), F.lit("\n")).alias("lrc"))


def _length(n: int) -> bytes:
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def midi(slots: list[tuple[float, float, int, str, bool]]) -> bytes:
    """A type-0 file with 960 ticks a second of (start, end, pitch, lyric, continuation); a continuation has no lyric."""
    events = []
    for start, end, pitch, lyric, goes_on in slots:
        a = round(start * 960)
        b = max(round(end * 960), a + 1)
        if not goes_on:
            text = lyric.encode()
            events.append((a, 1, b"\xff\x05" + _length(len(text)) + text))
        events += [(b, 0, bytes((0x80, pitch, 0))), (a, 2, bytes((0x90, pitch, 80)))]
    track, at = b"\x00\xff\x51\x03" + (1_000_000).to_bytes(3, "big"), 0
    for tick, _, data in sorted(events):
        track, at = track + _length(tick - at) + data, tick
    track += b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, 960) + b"MTrk" + struct.pack(">I", len(track)) + track


def musicxml(slots: list[tuple[int, int, int, str, bool]], measure: int = 4000) -> str:
    """A part at 60 beats a minute with measures of `measure` ms of (start ms, end ms, pitch, lyric, continuation)."""
    steps = "C C# D D# E F F# G G# A A# B".split()
    parts, at = [], 0
    for start, end, pitch, lyric, goes_on in slots:
        if start > at:
            parts.append((at, start, None, "", False))
        parts.append((start, end, pitch, lyric, goes_on))
        at = end
    notes: dict[int, list[str]] = {}
    for start, end, pitch, lyric, goes_on in parts:
        for m in range(start // measure, (end - 1) // measure + 1):
            a, b = max(start, m * measure), min(end, (m + 1) * measure)
            body = "<rest/>"
            if pitch is not None:
                step = steps[pitch % 12]
                body = f"<pitch><step>{step[0]}</step>{'<alter>1</alter>' if '#' in step else ''}<octave>{pitch // 12 - 1}</octave></pitch>"
            tie = "" if pitch is None else ("<tie type=\"stop\"/>" if a > start else "") + ("<tie type=\"start\"/>" if b < end else "")
            words = f"<lyric><text>{escape(lyric)}</text></lyric>" if lyric and a == start and not goes_on else ""
            notes.setdefault(m, []).append(f"<note>{body}<duration>{b - a}</duration>{tie}{words}</note>")
    head = f"<attributes><divisions>1000</divisions><time><beats>{measure // 1000}</beats><beat-type>4</beat-type></time></attributes>"
    body = "".join(f"<measure number=\"{m + 1}\">{head if m == 0 else ''}{''.join(notes.get(m, []))}</measure>" for m in range(max(notes, default=0) + 1))
    return f"<?xml version=\"1.0\" encoding=\"UTF-8\"?>\n<score-partwise version=\"4.0\"><part-list><score-part id=\"P1\"><part-name>Voice</part-name></score-part></part-list><part id=\"P1\">{body}</part></score-partwise>\n"


def ust(slots: list[tuple[int, int, int, str]]) -> str:
    """UST text of (start ms, end ms, pitch, kana): 480 ticks a beat at 120 beats a minute, with rests in the gaps."""
    out, at, n = ["[#VERSION]\nUST Version1.2\n[#SETTING]\nTempo=120.00"], 0, 0
    for start, end, pitch, kana in slots:
        for length, lyric, key in ((start - at, "R", 60), (end - start, kana, pitch)):
            if length > 0:
                out.append(f"[#{n:04d}]\nLength={round(length * 0.96)}\nLyric={lyric}\nNoteNum={key}")
                n += 1
        at = end
    return "\n".join([*out, "[#TRACKEND]\n"])


@F.udf(T.BinaryType())
def midi_bytes(slots) -> bytes:
    """midi() of an array of structs (start_sec, end_sec, midi_pitch, kana, continuation)."""
    return midi(sorted((s.start_sec, s.end_sec, s.midi_pitch, s.kana, s.continuation) for s in slots))

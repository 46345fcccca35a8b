"""N-gram Jaccard join by universe-partition pigeonhole.

Links documents whose sets of word n-grams have a Jaccard similarity of at least `percent` / 100, and names their groups.

Method. The universe of shingle hashes is cut into equal segments. Sizes fall into bands; a band has as many segments as
the largest difference that two similar sets of the band can have, so two similar sets agree in a segment, or differ by one
element in a segment that is indexed with its one-deletion neighbourhood. How many segments of either kind a band gets is
chosen by cost. Equal signatures are candidates; parity sketches, and for large sets counts by bucket, that never exceed the true
difference discard most of them; what is left is verified on the whole sets. Equal sets are one class from the start, and shared.bucket_groups joins the
classes without expanding groups of copies into all their pairs.

Defined results: null, empty or wordless text has no shingle and is linked with nothing; with fewer words than the n-gram the
whole sequence is one shingle; a repeated doc_id is one node with the links of all its rows; rows with a null doc_id come
back with a null component; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

#: Sizes of a band reach up to this multiple of its smallest.
BAND = 1.5
U64 = np.uint64
#: 64-bit words of the sketch that pairs are compared by.
WIDE = 16
#: Buckets of the counts that large sets are compared by, and the elements from which on a set is large: the wide sketch is full then.
COUNTS, LARGE = 1024, 1000
TABLE = "doc_id long, n_shingles long, k1 long, k2 long, wide array<long>, counts array<tinyint>"
ENTRIES = "sig long, id long"


def required(a: int, b: int, percent: int) -> int:
    """Least intersection of sets of sizes a and b that are similar enough."""
    return -(-percent * (a + b) // (100 + percent))


def most_difference(a: int, b: int, percent: int) -> int:
    return a + b - 2 * required(a, b, percent)


@lru_cache(None)
def bands(percent: int, up_to: int) -> tuple[int, ...]:
    """First sizes of the bands; the partner of a set is in its own band or the next."""
    out = [1]
    while out[-1] <= up_to:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * BAND), math.ceil(out[-1] * 100 / percent)))
    return tuple(out)


#: Chance that a set has a given element of an unrelated one; enters the cost of an allocation only.
COMMON = 0.05


@lru_cache(None)
def allocate(low: int, high: int, percent: int, rows: int) -> tuple[int, int, int, int]:
    """Numbers (exact, deletion, spare, least) of segments for pairs whose smaller set has a size in [low, high).

    A failing exact segment has a difference at least, a failing one with deletions two; exact + 2 * deletion exceeds the largest
    difference by 1 + spare, so segments of that weight agree. A set whose segments of less than `least` elements (one more for
    segments with deletions) weigh `spare` at most has an agreeing segment beside them and need not meet others in them, which
    unrelated sets may easily share. Cost: signatures of a set plus chance partners among `rows` sets.
    """
    most = max(most_difference(high - 1, x, percent) for x in (high - 1, (high - 1) * 100 // percent))
    if most == 0:
        return 0, 0, 0, 0  # only equal sets
    size, best = (low + high - 1) / 2, None
    poisson = lambda w, k: math.exp(k * math.log(w) - w - math.lgamma(k + 1))
    for deletion in range((most + 2) // 2 + 1):
        for least in range(4):
            spare, need = 0, 0
            for _ in range(20):  # more segments hold less, so more of them are thin: not every choice settles
                exact = max(0, most + 1 + spare - 2 * deletion)
                w = size / (exact + deletion)
                thin = exact * sum(poisson(w, k) for k in range(least)) + 2 * deletion * sum(poisson(w, k) for k in range(least + 1 if least else 0))
                need = math.ceil(thin + 2 * math.sqrt(thin))
                if need <= spare:
                    break
                spare = need
            if need > spare or w < 1.5 and least:
                continue
            chance = rows / 20 * 0.01 * sum(poisson(w, k) ** 2 * COMMON**k for k in range(least, least + 4))
            held = 1 - sum(poisson(w, k) for k in range(least))
            cost = exact * (held + chance) + deletion * (held + w) * (1 + chance * (1 + 2 * w))
            if best is None or cost < best[0]:
                best = cost, exact, deletion, exact + 2 * deletion - most - 1, least
    return best[1:]


def _schemes(n: int, percent: int, rows: int) -> list[tuple[int, int, int, int, int]]:
    if not n:
        return []
    first = bands(percent, max(1024, 1 << n.bit_length()))
    k = int(np.searchsorted(first, n, "right")) - 1
    out = [(k, *allocate(first[k], first[k + 1], percent, rows))]
    if k and n <= (first[k] - 1) * 100 // percent:
        out.append((k - 1, *allocate(first[k - 1], first[k], percent, rows)))
    return [x for x in out if x[1] + x[2]]


def signatures(h: np.ndarray, percent: int, rows: int) -> np.ndarray:
    """Signatures of one sorted set of hashes: sums over ranges of the hash universe, and the sums less one element."""
    out = []
    elements = S.mix(h ^ U64(0x5851F42D4C957F2D))
    total = np.concatenate([np.zeros(1, U64), np.cumsum(elements, dtype=U64)])
    for k, exact, deletion, spare, least in _schemes(len(h), percent, rows):
        m = exact + deletion
        edges = np.array([(i << 64) // m for i in range(1, m)], U64)
        at = np.concatenate([[0], np.searchsorted(h, edges, "left"), [len(h)]]).astype(np.int64)
        held = np.diff(at)
        tag = S.mix(np.arange(m, dtype=U64) + U64(((k << 24) + 1) << 16))
        sums = total[at[1:]] - total[at[:-1]]
        seg = np.repeat(np.arange(exact, m), held[exact:])
        tags, values = np.concatenate([tag, tag[seg]]), np.concatenate([sums, sums[seg] - elements[at[exact] :]])
        if np.count_nonzero(held[:exact] < least) + 2 * np.count_nonzero(held[exact:] < least + 1) <= spare:
            some = np.concatenate([held >= least, held[seg] > least])
            tags, values = tags[some], values[some]
        out.append(S.mix(values + tags))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, U64)


def parity_sketch(h: np.ndarray, words: int = 1) -> np.ndarray:
    """64 parities a word: two sets' sketches differ in at most as many bits as the sets in elements."""
    bits = np.bincount((h >> U64(3) & U64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def bucket_counts(h: np.ndarray) -> np.ndarray:
    """How many elements fall into each of COUNTS buckets: two sets' counts differ in all by at most as much as the sets, also where they end at 127."""
    return np.minimum(np.bincount((h >> U64(20) & U64(COUNTS - 1)).astype(np.int64), minlength=COUNTS), 127).astype(np.int8)


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted sets) of slices of a text column."""
    for first, raw, offsets in S.chunks(column):
        hashes, _, _, at = S.word_hashes(raw, offsets)
        yield first, [S.shingles(hashes[a:b], width) for a, b in zip(at[:-1], at[1:], strict=True)]


def _tables(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in _sets(batch.column(1), width):
                keys = np.array([(int(S.mix(h).sum(dtype=U64)), int(S.mix(h * U64(3) + U64(1)).sum(dtype=U64))) if len(h) else (0, 0) for h in rows], U64).view(np.int64)
                wide = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([parity_sketch(h, WIDE) for h in rows])), WIDE).cast(pa.list_(pa.int64()))
                counts = pa.array([bucket_counts(h) if len(h) > LARGE else None for h in rows], pa.list_(pa.int8()))
                yield pa.record_batch([batch.column(0).slice(first, len(rows)), pa.array([len(h) for h in rows], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), wide, counts], names=["doc_id", "n_shingles", "k1", "k2", "wide", "counts"])

    return run


def _entries(width: int, percent: int, n_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, rows in _sets(batch.column(1), width):
                sigs = [signatures(h, percent, n_rows) for h in rows]
                n = [len(x) for x in sigs]
                columns = (np.concatenate(sigs).view(np.int64), np.repeat(ids[first : first + len(rows)], n))
                yield pa.record_batch([pa.array(c) for c in columns], names=["sig", "id"])

    return run


def _verifier(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(column: pa.Array) -> Iterator[np.ndarray]:
            for _, rows in _sets(column, width):
                yield from rows

        last, known = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            left = batch.column(2)
            for i, y in enumerate(sets(batch.column(3))):
                if last is None or not left[i].as_buffer().equals(last):
                    last, known = left[i].as_buffer(), next(sets(left.slice(i, 1)))
                common = len(np.intersect1d(known, y, assume_unique=True))
                if common and common >= required(len(known), len(y), percent):
                    keep.append(i)
            yield pa.record_batch([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return run


def verify(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the written pairs (a, b) of doc_ids whose whole sets are similar enough; a text travels once for each pair."""
    scratch = S.Scratch(docs.sparkSession, "ngram-verify")
    ids = scratch.put(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = scratch.put(S.join_small(docs.select("doc_id", F.col("text").cast("binary").alias("text")), ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    rows = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right")), "b")
    rows = S.join_one(rows, texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), "a", most=0, counted=pairs)
    kept = S.materialize(rows.select("a", "b", "left", "right").mapInArrow(_verifier(width, percent), "a long, b long").distinct(), "ngram-links")
    scratch.drop()
    return kept


def jaccard_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, class_id, component_id), one for each row of docs.

    class_id is the smallest doc_id with the same set, component_id the smallest reachable by links; both are the doc_id
    itself for a set without elements.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = S.Scratch(docs.sparkSession, "ngram")
    table = scratch.put(docs.where("doc_id is not null").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(_tables(width), TABLE))
    held = table.where("n_shingles > 0").select("doc_id", "n_shingles", "k1", "k2")
    classes = scratch.put(held.groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")))
    common = scratch.put(classes.where("copies > 1").select(F.struct("k1", "k2").alias("k"), "class_id"))  # the others are alone in their class
    placed = S.join_one(scratch.put(held.select("doc_id", "n_shingles", F.struct("k1", "k2").alias("k"))), common, "k", "left")
    own = S.materialize(placed.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id")), "ngram-classes")
    leaders = scratch.put(own.where("doc_id = class_id").select("doc_id").distinct())
    n_rows = 1 << leaders.count().bit_length()
    texts = S.join_small(docs.where("text is not null").select("doc_id", F.col("text").cast("binary").alias("text")), leaders, "doc_id", "left_semi")
    entries = texts.mapInArrow(_entries(width, percent, n_rows), ENTRIES)

    def allowed(a: Column, b: Column) -> Column:  # largest difference of a link
        n = a["n_shingles"] + b["n_shingles"]
        return n - 2 * F.ceil(n * percent / (100 + percent) - 1e-9)

    def close(a: Column, b: Column) -> Column:
        size = F.greatest(a["n_shingles"], b["n_shingles"]) * percent <= F.least(a["n_shingles"], b["n_shingles"]) * 100
        return size & (F.bit_count(a["sketch"].bitwiseXOR(b["sketch"])) <= allowed(a, b))

    def closer(a: Column, b: Column) -> Column:
        return sum(F.bit_count(F.get(a["wide"], F.lit(i)).bitwiseXOR(F.get(b["wide"], F.lit(i)))) for i in range(WIDE)) <= allowed(a, b)

    def counted(pairs: DataFrame) -> DataFrame:
        """Pairs without those of large sets whose counts tell them apart."""
        side = lambda c, x: large.select(F.col("id").alias(c), F.struct("n_shingles", "counts").alias(x))
        apart = F.aggregate(F.zip_with(F.col("x.counts"), F.col("y.counts"), lambda x, y: F.abs(x - y)), F.lit(0), lambda s, d: s + d)
        rows = S.join_one(pairs, side("a", "x"), "a", "left", most=4000)
        other = side("c", "y")
        return scratch.put(rows.join(other, (F.col("b") == F.col("c")) & F.col("x").isNotNull() & (apart > allowed(F.col("x"), F.col("y"))), "left_anti").select("a", "b"))

    known = table.join(leaders, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "n_shingles", "wide", "counts")
    known = scratch.put(known.withColumn("sketch", F.reduce("wide", F.lit(0).cast("long"), lambda s, w: s.bitwiseXOR(w))))
    twice = own.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a <> b").select("doc_id", "a")
    large = known.where("counts is not null").join(twice.select(F.col("doc_id").alias("id")), "id", "left_anti")  # of one set each
    large = scratch.put(large.select("id", "n_shingles", "counts").dropDuplicates(["id"]))
    repeated = scratch.put(own.join(twice, "doc_id").where("class_id <> a").select("a", F.col("class_id").alias("b")))
    attributes = known.select("id", "n_shingles", "sketch")
    details = lambda ids: scratch.put(known.join(ids, "id", "left_semi").select("id", "n_shingles", "wide"))
    final = S.bucket_groups(entries, close, lambda pairs: verify(docs, counted(pairs), width, percent), "ngram-groups", attributes=attributes, details=details, closer=closer, known=repeated)
    grouped = S.join_one(own, final.select(F.col("node").alias("class_id"), F.col("component").alias("root")), "class_id", "left")
    alone = S.materialize(table.where("n_shingles = 0").select("doc_id", "n_shingles"), "ngram-empty")
    empty = docs.where("doc_id is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"))
    scratch.drop()
    return grouped.select("doc_id", "n_shingles", "class_id", F.coalesce("root", "class_id").alias("component_id")).unionByName(alone.union(empty).select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Documents without those that belong to the group of a smaller doc_id; all columns stay."""
    drop = S.materialize(jaccard_groups(docs, width, percent).where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return S.join_small(docs, drop, "doc_id", "left_anti")

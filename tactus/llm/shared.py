"""Helpers that several corpus operators share: written intermediates, word hashes and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = b" \t\n\x0b\x0c\r"
U64 = np.uint64


#: Removes a query's shuffle files once it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the checkpoint folder set in the session.

    Where neither is set, a session on one machine (master local) gets a folder of its own, as in tests; a cluster has to name one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
    if not at and spark.sparkContext.master.split("[")[0] == "local":
        at = "file://" + tempfile.mkdtemp(prefix="tactus-")
        spark.sparkContext.setCheckpointDir(at)
    if not at:
        raise ValueError("spark.checkpoint.dir is not set: the corpus operators need a folder that all executors share")
    return at.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tactus/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, partition_by: str | None = None, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back, so that a lost executor costs no recomputation.

    The shuffle files behind the table are removed once it is written.
    """
    spark, path = df.sparkSession, path or new_path(df.sparkSession, tag)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one run of an operator, deleted together."""

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark, self.root, self.n = spark, new_path(spark, tag), 0

    def put(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        self.n += 1
        return materialize(df, "", partition_by, f"{self.root}/{self.n}")

    def drop(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def few(table: DataFrame, most: int) -> bool:
    """Whether a written table has at most so many rows; its files' footers tell."""
    return table.count() <= most


def join_small(big: DataFrame, small: DataFrame, on: list[str] | str, how: str, most: int = 1_000_000) -> DataFrame:
    """Join with a broadcast while the written table `small` has at most `most` rows of a few fixed-width columns, else by shuffle."""
    return big.join(F.broadcast(small) if few(small, most) else small, on, how)


#: A key with more than 1 / HOT of all rows is hot, so there are less than HOT of them; its rows are dealt to SPREAD parts.
HOT, SPREAD = 1000, 64


def join_one(big: DataFrame, small: DataFrame, key: str, how: str = "inner", most: int = 1_000_000, counted: DataFrame | None = None) -> DataFrame:
    """Join the written tables `big` and `small`, the latter with one row for each key; `big` need not be written if `counted` is,
    which has its keys.

    With at most `most` rows of `small`, of fixed width, it is broadcast. Else rows of hot keys are salted, and the row of
    `small` repeated for each salt, so no task gets all rows of a frequent key.
    """
    if most and few(small, most):
        return big.join(F.broadcast(small), key, how)
    counted = big if counted is None else counted
    hot = materialize(counted.groupBy(key).count().where(F.col("count") * HOT > counted.count()).select(key, F.lit(True).alias("_hot")), "hot-keys")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*big.columns), F.lit(SPREAD)).cast("int")).otherwise(0)
    salts = F.when(F.col("_hot"), F.array(*map(F.lit, range(SPREAD)))).otherwise(F.array(F.lit(0)))
    dealt = big.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_hot")
    copies = small.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_ODD = U64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=U64) * _ODD)
_SEP = np.zeros(256, bool)
_SEP[list(SEPARATORS)] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_POW = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, up to n."""
    if _POW["n"] < n:
        size, base = max(n, 1 << 20), 0xD1342543DE82EF95
        for name, b in (("p", base), ("q", pow(base, -1, 1 << 64))):
            x = np.full(size, b, U64)
            x[0] = 1
            _POW[name] = np.multiply.accumulate(x)
        _POW["n"] = size
    return _POW["p"], _POW["q"]


def chunks(texts: pa.Array, most_bytes: int = 1 << 20):
    """Slices of a text column as (first row, bytes, offsets), whole texts only; a longer text is a slice by itself."""
    texts = texts.cast(pa.binary()) if not pa.types.is_large_binary(texts.type) else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    n = len(texts)
    if not n:
        return
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, wide)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1)
        last = min(last, n)
        yield first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True, separators: np.ndarray = _SEP, tails: np.ndarray | None = None):
    """64-bit hashes of all words of a slice, their first bytes and ends, and where each text's words begin.

    Words are runs of other bytes than SEPARATORS, or than those that `separators` marks; texts do not run into one another; A-Z
    count as a-z with lower. A last byte that `tails` marks, after an ASCII letter, is a word of its own.
    """
    n = len(raw)
    inside = ~separators[raw]
    edge = np.empty(n + 1, bool)
    edge[:n], edge[n] = inside, False
    edge[1:n] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    edge[cut] = inside[cut]
    starts = np.flatnonzero(edge[:n])
    stop = np.empty(n + 1, bool)
    stop[0], stop[n] = False, n > 0 and inside[-1]
    stop[1:n] = inside[:-1] & ~inside[1:]
    inner = cut[cut > 0]
    stop[inner] = inside[inner - 1]
    ends = np.flatnonzero(stop)
    if tails is not None and len(starts):
        apart = ends[(ends - starts > 1) & tails[raw[ends - 1]] & _LETTER[raw[np.maximum(ends - 2, 0)]]] - 1
        starts, ends = np.sort(np.concatenate([starts, apart])), np.sort(np.concatenate([ends, apart]))
    p, q = _powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum((_LOWER if lower else _BYTE)[raw] * p[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(U64) * _ODD)
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word windows of one text; the whole sequence where it is shorter; none without words."""
    n = len(words)
    if not n:
        return words
    return np.unique(windows(words, width))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words)
    k = min(n, width)
    out = np.zeros(n - k + 1, U64)
    for i in range(k):
        out = out * U64(0xA0761D6478BD642F) + words[i : i + n - k + 1]
        out ^= out >> U64(29)
    return mix(out + U64(k))


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), component the smallest node.

    Minimum labels with pointer jumping: every round takes the smallest label of the neighbours and then the label of that
    label, so chains shorten geometrically. Each round is written to the shared folder; the last one stays.
    """
    scratch = Scratch(edges.sparkSession, f"{tag}-labels")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.put(both)
    labels = scratch.put(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component"), F.lit(True).alias("moved")))
    while labels.where("moved").take(1):
        heard = join_one(both, labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        hooked = labels.select("node", "component").join(heard, "node").select("node", F.col("component").alias("old"), F.least("component", "heard").alias("via"))
        hooked = hooked if few(labels, 1_000_000) else scratch.put(hooked)
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("further"))
        new = hooked.join(F.broadcast(jump), "via") if few(labels, 1_000_000) else join_one(hooked, jump, "via")
        labels = scratch.put(new.select("node", F.least("via", "further").alias("component"), (F.least("via", "further") < F.col("old")).alias("moved")))
    out = materialize(labels.select("node", "component"), f"{tag}-components")
    scratch.drop()
    return out


#: Rows of a bucket that every later row is compared with.
LEADERS = 8


def in_common(entries: DataFrame) -> DataFrame:
    """The entries whose sig another entry has, too. They are dealt by sig once, for the count and for the choice."""
    dealt = entries.where("sig is not null and id is not null").repartition("sig")
    others = [c for c in entries.columns if c != "sig"]
    shared = dealt.groupBy("sig").agg(F.count("*").alias("_n"), *(F.max(c).alias(f"_{c}") for c in others)).where("_n > 1")  # all columns, so that both read one exchange
    return dealt.join(shared.hint("shuffle_hash"), "sig").where(F.col("_id") >= F.col("id")).select(*entries.columns)


def bucket_groups(
    entries: DataFrame,
    close: Callable[[Column, Column], Column],
    verify: Callable[[DataFrame], DataFrame],
    tag: str,
    attributes: DataFrame | None = None,
    details: Callable[[DataFrame], DataFrame] | None = None,
    closer: Callable[[Column, Column], Column] | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """Components (node, component) of links; a link is a pair in a common bucket that verify() keeps, or an edge of `known`.

    entries: rows (sig, id, further columns), one for each bucket of a node; attributes: rows (id, further columns), joined to
    the entries that share a bucket. close(a, b) tells from two such rows whether they can be linked. Within a bucket every row
    meets the first LEADERS rows, so smaller buckets are covered whole. Each node's partner in most buckets is verified first;
    what these links join is one group. The other partners, then pairs of later rows of large buckets, are only verified where
    they lie in different groups by then. So a group of copies costs about one pair for each member, and every pair of a bucket
    is either verified or within a group. details(ids): a written table (id, further columns) of those nodes, with which
    closer(a, b) tells more exactly, of pairs only, whether they can be linked.
    """
    scratch = Scratch(entries.sparkSession, tag)
    common = in_common(entries)
    if attributes is not None:
        common = join_small(common, attributes, "id", "inner")
    columns = [c for c in common.columns if c != "sig"]
    at = Window.partitionBy("sig").orderBy("id")
    seen = at.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    me = F.struct(*columns)
    rows = common.withColumn("rank", F.row_number().over(at)).withColumn("next", F.lead("id").over(at)).withColumn("firsts", F.array(*(F.nth_value(me, i + 1).over(seen) for i in range(LEADERS)))).where("rank > 1")
    none = F.lit(None).cast(common.select(me.alias("r")).schema["r"].dataType)
    pair = lambda x: F.struct(F.lit(0).alias("kind"), x["id"].alias("a"), F.col("id").alias("b"), F.lit(None).cast("long").alias("sig"), none.alias("row"))
    met = F.transform(F.filter("firsts", lambda x: x.isNotNull() & (x["id"] != F.col("id")) & close(x, me)), pair)
    late = F.struct(F.lit(1).alias("kind"), F.col("id").alias("a"), F.col("id").alias("b"), F.col("sig").alias("sig"), me.alias("row"))
    found = scratch.put(rows.select(F.explode(F.concat(met, F.when(F.col("rank") > LEADERS, F.array(late)).otherwise(F.array()))).alias("f")).select("f.*"), "kind")
    met = scratch.put(found.where("kind = 0").groupBy("a", "b").agg(F.count("*").alias("n")))
    rest = found.where("kind = 1").select("sig", "row.*")
    if details is not None:
        of = details(found.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        side = lambda c, x: of.select(F.col("id").alias(c), F.struct(*of.columns).alias(x))
        met = join_small(join_one(met, side("a", "x"), "a", "inner", 200_000), side("b", "y"), "b", "inner", 200_000).where(closer(F.col("x"), F.col("y"))).select("a", "b", "n")
        met, rest = scratch.put(met), join_small(rest, of.select("id", F.struct(*of.columns).alias("more")), "id", "inner", 200_000)

    def label(df: DataFrame, groups: DataFrame, c: str, hot: bool = False) -> DataFrame:
        named = groups.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
        return (join_one if hot else join_small)(df, named, c, "left").withColumn(f"c_{c}", F.coalesce(f"c_{c}", c))

    nearest = scratch.put(met.groupBy("b").agg(F.min(F.struct((-F.col("n")).alias("n"), "a")).alias("m")).select(F.col("m.a").alias("a"), "b"))
    first = verify(nearest)
    joined = components(first if known is None else first.unionByName(known.select("a", "b")), f"{tag}-first")
    as_edges = lambda g: g.select(F.col("component").alias("a"), F.col("node").alias("b"))
    others = scratch.put(met.join(nearest, ["a", "b"], "left_anti"))
    across = label(label(others, joined, "a", True), joined, "b").where("c_a <> c_b").select("a", "b")
    across = scratch.put(across)
    if across.take(1):
        further = scratch.put(verify(across))
        if further.take(1):
            joined = components(as_edges(joined).union(further), f"{tag}-second")
    if found.where("kind = 1").take(1):
        placed = scratch.put(label(rest, joined, "id"))
        mixed = scratch.put(placed.groupBy("sig").agg(F.min("c_id").alias("lo"), F.max("c_id").alias("hi")).where("lo <> hi").select("sig"))
        placed = join_small(placed, mixed, "sig", "left_semi")  # the others hold no pair of two groups
        l, r = (placed.select(F.col("sig").alias(f"sig_{x}"), F.struct(*(c for c in placed.columns if c != "sig")).alias(x)) for x in "lr")
        can = (F.col("sig_l") == F.col("sig_r")) & (F.col("l.id") < F.col("r.id")) & (F.col("l.c_id") != F.col("r.c_id")) & close(F.col("l"), F.col("r"))
        if details is not None:
            can &= closer(F.col("l.more"), F.col("r.more"))
        more = scratch.put(l.join(r, can).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct())
        if more.take(1):
            further = scratch.put(verify(more))
            if further.take(1):
                joined = components(as_edges(joined).union(further), f"{tag}-third")
    scratch.drop()
    return joined

"""Quality rules for documents and for their hosts, as DataFrame expressions only.

Every document gets counts of its whole text and rule failures. Failures are summed by host; a host's rate of each rule is
shrunk towards all hosts with a beta prior whose parameters come from the data: the rate of all documents, and how much more the
hosts' rates differ than chance makes them. So a host with few documents says little. A host is rejected where a shrunk rate exceeds `MOST`; its documents go with it.

Words are runs of other characters than space, tab, line feed, vertical tab, form feed and carriage return. Defined results:
null and empty texts have no words and fail the length rule; a null host is a host of its own; a repeated row counts each time;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Words of a window that counts as repeated.
WINDOW = 8
#: Shrunk failure rate above which a host is rejected.
MOST = 0.5
RULES = ("short", "repeats", "symbols", "lines", "word_length")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words inside windows that the text holds more than once.

    Texts whose windows all differ, most of them, are told by a set. For the others the windows are sorted by hash, neighbours
    with the same hash are kept, and the gaps between their places say how many words they cover.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    at = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))

    def covered(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(s, 1, F.size(s) - 1))
            after = F.slice(s, 2, F.size(s))
            near = F.zip_with(F.zip_with(s, before, lambda x, b: F.struct(x["i"].alias("i"), x["h"].alias("h"), F.coalesce(x["h"] == b["h"], F.lit(False)).alias("same"))), after, lambda x, a: F.when(x["same"] | F.coalesce(x["h"] == a["h"], F.lit(False)), x["i"]))
            return F.sort_array(F.filter(near, lambda i: i.isNotNull()))

        gaps = lambda p: F.zip_with(F.slice(p, 2, F.size(p)), p, lambda b, a: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return let(let(ordered, twice), lambda p: F.aggregate(gaps(p), F.lit(0).cast("long"), lambda s, g: s + g))

    zero = F.lit(0).cast("long")
    some = let(let(hashes, at), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), zero).otherwise(covered(w)))
    return F.when(F.size(words) <= WINDOW, zero).otherwise(some)


def counts(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", F.col("source").alias("host"), text.alias("text")).withColumn("words", F.filter(F.split("text", BLANK), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return split.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def failures(rows: DataFrame) -> DataFrame:
    """The rules as booleans."""
    n = F.col("n_words")
    return (
        rows.withColumn("short", n < 20)
        .withColumn("repeats", 100 * F.col("n_repeat_words") > 30 * n)
        .withColumn("symbols", 10 * F.col("n_symbols") > n)
        .withColumn("lines", 10 * F.col("n_dup_lines") > n)
        .withColumn("word_length", (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 12 * n))
    )


def host_verdicts(rows: DataFrame) -> DataFrame:
    """Rows (host, worst_rate, rejected): the shrunk rate of some rule exceeds MOST.

    The beta prior of a rule has the mean m of all documents and the weight a + b = 1 / rho - 1, where rho is the correlation of
    failures within hosts: what the hosts' rates, weighted by their documents, vary more than chance makes them vary. Chance
    counts for hosts of few documents, so those say little about rho; the weight lies between 1 and 999.
    """
    n = F.col("n")
    sums = rows.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(r).cast("long")).alias(r) for r in RULES))
    moments = sums.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(n * n / 1.0).alias("q"), *(f.alias(f"{k}_{r}") for r in RULES for k, f in (("x", F.sum(r)), ("s", F.sum(F.col(r) * F.col(r) / n))))).first()
    hosts, total = moments["k"], moments["n"] or 0
    shrunk = []
    for r in RULES:  # a dozen numbers, of all hosts
        m = (moments[f"x_{r}"] or 0) / total if total else 0.0
        free = total - moments["q"] / total - (hosts - 1) if total else 0.0
        spread = (moments[f"s_{r}"] - total * m * m) / (m * (1 - m)) if 0 < m < 1 else 0.0
        rho = min(0.5, max(0.001, (spread - (hosts - 1)) / free)) if free > 0 and spread else 0.001
        weight = 1 / rho - 1
        shrunk.append((F.col(r) + m * weight) / (n + weight))
    return sums.select("host", F.greatest(*shrunk, F.lit(0.0)).alias("worst_rate")).withColumn("rejected", F.col("worst_rate") > MOST)


def judge(docs: DataFrame) -> DataFrame:
    """Counts, failures and verdicts of every document."""
    rows = S.materialize(failures(counts(docs)), "host-counts")
    hosts = host_verdicts(rows)
    failed = F.col("short") | F.col("repeats")
    hosts = S.materialize(hosts.select(F.coalesce(F.concat(F.lit("h"), "host"), F.lit("")).alias("h"), "rejected", "worst_rate"), "host-verdicts")
    joined = S.join_small(rows.withColumn("h", F.coalesce(F.concat(F.lit("h"), "host"), F.lit(""))), hosts, "h", "left", most=100_000)
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce("rejected", F.lit(False)))

"""Quotation linking: conversations without quotes, in reply order, as DataFrame expressions.

A line's quote level is the number of > before its text; consecutive lines of one level are a passage. Of every level, hashes
of normalised passages (their lines joined, so wrapping does not matter) and lines are looked up among the unquoted passages and
lines of the same conversation's earlier messages; the latest one that holds a line's passage, or else the line, is its origin.
A message replies to the origin of most of its linked lines of the lowest level that has any, the later one on a tie, and
without such a line to the message before it. Part of a passage that is wrapped anew is not linked.
A conversation is then told
branch by branch: a message continues the branch of the message it replies to if it is that message's first reply and begins a
branch otherwise; branches come in the order of their first messages, so replies follow what they reply to.

Origins come from one sort of quoted and original lines by (conversation, hash, turn), never from pairs.

Defined results: null text is an empty message and stays null; rows with a null conv_id or turn come back without links; rows that
repeat a (conv_id, turn) are one message for links and come back each; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S

MARKS = r"^\s*(?:>\s*)+"


def level(line: Column) -> Column:
    """Number of quote marks before a line's text."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"\s+", ""))


def normal(line: Column) -> Column:
    """A line without marks, case, punctuation and surplus spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"[^\p{L}\p{N}]+", " "))


def replies(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, parent, n_quoted, n_linked): parent is the turn replied to, null for the first message."""
    named = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    lines = named.withColumn("m", F.monotonically_increasing_id()).select("conv_id", "turn", "m", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("conv_id", "turn", "m", "pos", level(F.col("line")).alias("level"), normal(F.col("line")).alias("n"))
    quoting = S.materialize(lines.where("level > 0 and n <> ''").select("conv_id").distinct(), "quotes")
    if quoting.take(1):
        message = Window.partitionBy("conv_id", "turn", "m").orderBy("pos")
        begins = (F.lag("level").over(message) != F.col("level")) | (F.lag("n").over(message) == "")
        told = lines.join(quoting, "conv_id", "left_semi").withColumn("begins", F.coalesce(begins, F.lit(False)).cast("int")).withColumn("passage", F.sum("begins").over(message)).where("n <> ''")
        told = told.groupBy("conv_id", "turn", "m", "passage", "level").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("l")).withColumn("l", F.col("l.n"))
        hashed = lambda c: F.struct(F.xxhash64(c), F.xxhash64(F.lit(1), c))
        told = S.materialize(told.select("conv_id", "turn", "level", F.transform("l", hashed).alias("lines"), hashed(F.array_join("l", " ")).alias("p")), "passages")
        quoted = told.where("level > 0").select("conv_id", "turn", "level", F.explode("lines").alias("n"), "p").groupBy("conv_id", "turn", "level", "n", "p").count()
        asked = quoted.select("conv_id", "turn", F.explode(F.array("n", "p")).alias("h")).distinct().withColumn("own", F.lit(False))
        own = told.where("level = 0").select("conv_id", "turn", F.explode(F.concat("lines", F.array("p"))).alias("h")).distinct().withColumn("own", F.lit(True))
        before = Window.partitionBy("conv_id", "h").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
        found = asked.unionByName(own).withColumn("origin", F.max(F.when(F.col("own"), F.col("turn"))).over(before)).where("not own and origin is not null")
        by = lambda c: found.select("conv_id", "turn", F.col("h").alias(c), F.col("origin").alias(f"of_{c}"))
        origins = quoted.join(by("n"), ["conv_id", "turn", "n"], "left").join(by("p"), ["conv_id", "turn", "p"], "left").withColumn("origin", F.coalesce("of_p", "of_n")).where("origin is not null")
        votes = origins.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("count").alias("n"))
        linked = votes.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("level"), "n", "origin")).alias("best"), F.sum("n").alias("n_linked")).select("conv_id", "turn", F.col("best.origin").alias("origin"), "n_linked")
    else:
        linked = named.select("conv_id", "turn", F.col("turn").alias("origin"), F.lit(0).cast("long").alias("n_linked")).limit(0)
    counts = named.groupBy("conv_id", "turn").agg(F.sum(F.size(F.filter(F.split("text", "\n"), lambda l: level(l) > 0))).alias("n_quoted"))
    previous = Window.partitionBy("conv_id").orderBy("turn")
    rows = counts.join(linked, ["conv_id", "turn"], "left").withColumn("parent", F.coalesce("origin", F.lag("turn").over(previous)))
    return rows.select("conv_id", "turn", "parent", "n_quoted", F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"))


def branches(rows: DataFrame) -> DataFrame:
    """replies() with the turn that begins the message's branch; conversations that only go on are one branch without a join."""
    firsts = Window.partitionBy("conv_id", "parent").orderBy("turn")
    rows = rows.withColumn("continues", F.col("parent").isNotNull() & (F.row_number().over(firsts) == 1))
    split = rows.groupBy("conv_id").agg(F.min("turn").alias("first"), F.count_if(~F.col("continues")).alias("n"))
    rows = S.materialize(rows.join(split, "conv_id"), "replies")
    simple = rows.where("n = 1").withColumn("branch", F.col("first"))
    hard = rows.where("n > 1")
    if hard.take(1):  # pointers to the branch's first message double their reach every round
        at = S.materialize(hard.withColumn("branch", F.when(F.col("continues"), F.col("parent")).otherwise(F.col("turn"))), "branch")
        while True:
            jump = at.select("conv_id", F.col("turn").alias("branch"), F.col("branch").alias("further"))
            new = S.materialize(at.join(jump, ["conv_id", "branch"]).withColumn("moved", F.col("further") != F.col("branch")).withColumn("branch", F.col("further")).drop("further"), "branch")
            if not new.where("moved").take(1):
                break
            at = new.drop("moved")
        simple = simple.unionByName(at.select(simple.columns))
    return simple.select("conv_id", "turn", "parent", "n_quoted", "n_linked", "branch")


OWN = ("parent", "branch", "position", "n_quoted", "n_linked", "clean")


def conversations(messages: DataFrame) -> DataFrame:
    """messages with parent, branch, position in reply order from 0, n_quoted, n_linked and `clean`: the text without quoted lines.

    Columns of messages stay, but for those of these names, which the results replace.
    """
    placed = branches(replies(messages))
    order = Window.partitionBy("conv_id").orderBy("branch", "turn")
    placed = placed.withColumn("position", F.row_number().over(order).cast("long") - 1)
    placed = placed.select(F.struct("conv_id", "turn").alias("key"), F.struct("parent", "branch", "position", "n_quoted", "n_linked").alias("found"))
    rows = messages.select(F.struct(*(c for c in messages.columns if c not in OWN)).alias("m"))
    joined = rows.join(placed, (F.col("m.conv_id") == F.col("key.conv_id")) & (F.col("m.turn") == F.col("key.turn")), "left")
    text = F.col("m.text")
    clean = F.array_join(F.filter(F.split(text, "\n"), lambda l: level(l) == 0), "\n")
    return joined.select("m.*", "found.*", F.when(F.coalesce("found.n_quoted", F.lit(1)) == 0, text).otherwise(F.trim(clean)).alias("clean"))

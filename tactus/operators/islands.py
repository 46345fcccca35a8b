"""Gap-and-island operators over ordered rows: one window pass each, partitioned by the caller's keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cols(names: str | list[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def islands(df: DataFrame, keys, start: str, end: str, order, gap, same: list[str] | None = None, name: str = "island") -> DataFrame:
    """Number the runs of rows whose gap to everything before is at most `gap`; a gap of exactly `gap` joins.

    The gap counts from the largest end so far, so a long row bridges short ones. With `same`, a change in those columns
    begins a run as well. Numbers start at 1 within the keys.
    """
    w = Window.partitionBy(*cols(keys)).orderBy(*cols(order))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    new = F.max(end).over(before).isNull() | (F.col(start) > F.max(end).over(before) + gap)
    for c in same or []:
        new |= ~F.col(c).eqNullSafe(F.lag(c).over(w))
    flagged = df.withColumn("_new", F.when(new, 1).otherwise(0))
    return flagged.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")).drop("_new")


def bounds(df: DataFrame, keys, start: str, end: str, name: str = "island") -> DataFrame:
    """First start, last end and number of rows of every run."""
    return df.groupBy(*cols(keys), name).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"))


def merged(df: DataFrame, keys, start: str, end: str, gap) -> DataFrame:
    """Union of intervals: overlapping ones, and those within `gap`, become one."""
    return bounds(islands(df, keys, start, end, [start, end], gap), keys, start, end)


def two_level(df: DataFrame, keys, start: str, end: str, order, gap, least: int, wide_gap, wide_least: int) -> DataFrame:
    """Runs by `gap` of at least `least` rows, joined to larger runs by `wide_gap` that hold at least `wide_least` rows."""
    small = bounds(islands(df, keys, start, end, order, gap), keys, start, end).where(F.col("n") >= least).drop("island")
    large = islands(small, keys, "start", "end", ["start", "end"], wide_gap)
    return large.groupBy(*cols(keys), "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.count("*").alias("parts")).where(F.col("n") >= wide_least)


def first_runs(runs: DataFrame, keys, least: int, most_runs: int) -> DataFrame:
    """The first `most_runs` runs of each key that have at least `least` rows."""
    w = Window.partitionBy(*cols(keys)).orderBy("start", "end")
    return runs.where(F.col("n") >= least).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most_runs)


def run_lengths(df: DataFrame, keys, value: str, order) -> DataFrame:
    """Runs of equal neighbouring values with the places of their first and last row."""
    w = Window.partitionBy(*cols(keys)).orderBy(*cols(order))
    placed = df.withColumn("_at", F.row_number().over(w).cast("long")).withColumn("_new", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1))
    placed = placed.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long"))
    return placed.groupBy(*cols(keys), F.col("_run").alias("run"), value).agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count("*").alias("n"))


def propagate(df: DataFrame, keys, order, seed: Column, can: Column, linked: Column | None = None) -> DataFrame:
    """Label rows that a seed reaches over neighbours that can take the label: the fix point of spreading to both sides.

    A run is a stretch of neighbours that are seeds or can be labelled, linked to one another; one with a seed is labelled
    whole. `linked` tells whether a row is linked to the row before it.
    """
    w = Window.partitionBy(*cols(keys)).orderBy(*cols(order))
    rows = df.withColumn("_seed", F.coalesce(seed, F.lit(False))).withColumn("_in", F.coalesce(seed | can, F.lit(False)))
    joins = F.col("_in") & F.coalesce(F.lag("_in").over(w), F.lit(False))
    if linked is not None:
        joins &= F.coalesce(linked, F.lit(False))
    rows = rows.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    reached = F.max(F.col("_seed").cast("int")).over(Window.partitionBy(*cols(keys), "_run")) == 1
    return rows.withColumn("labelled", F.col("_in") & reached).drop("_seed", "_in", "_new", "_run")

"""Integrity rules as queries: each gives rows (rule, owner, detail) of what breaks it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import cols


def violations(df: DataFrame, rule: str, owner: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), owner.cast("string").alias("owner"), detail.cast("string").alias("detail"))


def broken(df: DataFrame, rule: str, owner: str, holds: Column, detail: Column) -> DataFrame:
    """Rows that do not satisfy a predicate; unknown counts as broken."""
    return violations(df.where(~F.coalesce(holds, F.lit(False))), rule, F.col(owner), detail)


def unique(df: DataFrame, rule: str, ids) -> DataFrame:
    counted = df.groupBy(*cols(ids)).count().where("count > 1")
    return violations(counted, rule, F.concat_ws("/", *cols(ids)), F.col("count"))


def resolves(df: DataFrame, rule: str, owner: str, reference: str, targets: DataFrame, target: str) -> DataFrame:
    """References that no target has; a null reference is none."""
    missing = df.where(F.col(reference).isNotNull()).join(targets.select(F.col(target).alias(reference)).distinct(), reference, "left_anti")
    return violations(missing, rule, F.col(owner), F.col(reference))


def reciprocal(left: DataFrame, right: DataFrame, rule: str, a: str, b: str) -> DataFrame:
    """Edges (a, b) that only one of two tables has."""
    l, r = left.select(a, b).distinct(), right.select(a, b).distinct()
    one = l.exceptAll(r).withColumn("_side", F.lit("left")).union(r.exceptAll(l).withColumn("_side", F.lit("right")))
    return violations(one, rule, F.col(a), F.concat_ws(":", "_side", F.col(b).cast("string")))


def ordered(df: DataFrame, rule: str, keys, order, start: str, end: str, tolerance) -> DataFrame:
    """Rows that begin before the row before them ends."""
    w = Window.partitionBy(*cols(keys)).orderBy(*cols(order))
    bad = df.withColumn("_before", F.lag(end).over(w)).where(F.col(start) < F.col("_before") - tolerance)
    return violations(bad, rule, F.concat_ws("/", *(F.col(k).cast("string") for k in cols(keys))), F.col(start))


def partition(whole: DataFrame, parts: dict[str, DataFrame], rule: str, key: str) -> DataFrame:
    """Keys that no part or more than one part holds, and keys of parts that the whole lacks."""
    held = reduce(DataFrame.union, [p.select(key).distinct().withColumn("_part", F.lit(n)) for n, p in parts.items()])
    both = whole.select(key).distinct().withColumn("_whole", F.lit(True)).join(held, key, "full_outer")
    counted = both.groupBy(key).agg(F.max("_whole").alias("w"), F.count("_part").alias("n"), F.array_join(F.sort_array(F.collect_set("_part")), "+").alias("in"))
    return violations(counted.where("w is null or n <> 1"), rule, F.col(key), F.col("in"))

"""Aggregates, consensus and ordered selection with explicit tie-breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import cols


def best_row(df: DataFrame, keys, order: list[Column]) -> DataFrame:
    """The first row of every key in the given order, found by a partial aggregate: no sort of whole groups."""
    rest = [c for c in df.columns if c not in cols(keys)]
    best = F.min(F.struct(*(o.alias(f"_{i}") for i, o in enumerate(order)), F.struct(*rest).alias("_row"))).alias("_b")
    return df.groupBy(*cols(keys)).agg(best).select(*cols(keys), "_b._row.*")


def first_distinct(df: DataFrame, keys, value: str, order) -> DataFrame:
    """Distinct values of a key with the place among them, in the order of their first occurrence."""
    first = df.groupBy(*cols(keys), value).agg(F.min(F.struct(*cols(order))).alias("_first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*cols(keys)).orderBy("_first")).cast("long")).drop("_first")


def mode_first(df: DataFrame, keys, value: str, order) -> DataFrame:
    """The commonest value of a key; of equally common ones the one that comes first."""
    counted = df.groupBy(*cols(keys), value).agg(F.count("*").alias("n"), F.min(F.struct(*cols(order))).alias("_first"))
    return best_row(counted, keys, [-F.col("n"), F.col("_first")]).drop("_first")


def softmax(df: DataFrame, keys, cost: str) -> DataFrame:
    """Probabilities of alternatives from their costs: exp(least - cost), in proportion."""
    w = Window.partitionBy(*cols(keys))
    rows = df.withColumn("_e", F.exp(F.min(cost).over(w) - F.col(cost)))
    return rows.withColumn("probability", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def margin(df: DataFrame, keys, cost: str) -> DataFrame:
    """Confidence in the cheapest alternative: m / (m + 1) with the margin m to the second; 1 without a second."""
    ordered = F.slice(F.sort_array(F.collect_list(cost)), 1, 2)
    two = df.withColumn("_r", F.row_number().over(Window.partitionBy(*cols(keys)).orderBy(cost))).where("_r <= 2").groupBy(*cols(keys)).agg(ordered.alias("_c"))
    m = F.get("_c", F.lit(1)) - F.get("_c", F.lit(0))
    return two.select(*cols(keys), F.get("_c", F.lit(0)).alias("cost"), F.when(F.size("_c") < 2, F.lit(1.0)).otherwise(m / (m + 1)).alias("confidence"))


def medoid(df: DataFrame, keys, item: str, agreement: Column, left: str = "a", right: str = "b") -> DataFrame:
    """The item with the largest mean agreement with the others of its key; the smallest item on a tie.

    `agreement` speaks of the columns <left>.<column> and <right>.<column>. Keys are small groups of alternatives.
    """
    a, b = df.alias(left), df.alias(right)
    on = [F.col(f"{left}.{k}") == F.col(f"{right}.{k}") for k in cols(keys)] + [F.col(f"{left}.{item}") != F.col(f"{right}.{item}")]
    means = a.join(b, on).groupBy(*(F.col(f"{left}.{k}").alias(k) for k in cols(keys)), F.col(f"{left}.{item}").alias(item)).agg(F.avg(agreement).alias("agreement"))
    return best_row(means, keys, [-F.col("agreement"), F.col(item)])


def consensus(votes: DataFrame, keys, option: str, view: str, distance: str, default: Column, least_gain: float) -> DataFrame:
    """Choose among options by the sum of distances over views; the default stays unless another is clearly better.

    An option beats the default if its sum is less by `least_gain` at least and it is worse in no view. Among these the least
    (sum, option) wins. Reasons: default_best, no_gain, view_conflict, chosen.
    """
    rows = votes.withColumn("_default", default)
    per_view = rows.where("_default").select(*cols(keys), view, F.col(distance).alias("_base"))
    both = rows.where("not _default").join(per_view, [*cols(keys), view])
    sums = both.groupBy(*cols(keys), option).agg(F.sum(distance).alias("total"), F.sum("_base").alias("base"), F.max(F.col(distance) > F.col("_base")).alias("worse"))
    wins = sums.withColumn("reason", F.when(F.col("total") >= F.col("base"), "default_best").when(F.col("worse"), "view_conflict").when(F.col("base") - F.col("total") < least_gain, "no_gain").otherwise("chosen"))
    rank = F.when(F.col("reason") == "chosen", 0).when(F.col("reason") == "no_gain", 1).when(F.col("reason") == "view_conflict", 2).otherwise(3)
    best = best_row(wins, keys, [rank, F.col("total"), F.col(option)])
    chosen = rows.where("_default").groupBy(*cols(keys)).agg(F.min(option).alias("_d")).join(best, cols(keys), "left")
    return chosen.select(*cols(keys), F.when(F.col("reason") == "chosen", F.col(option)).otherwise(F.col("_d")).alias(option), F.coalesce("reason", F.lit("only_default")).alias("reason"))

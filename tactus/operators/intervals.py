"""Interval joins and interval sets. Every join has a key equality; the range is its residual condition.

One long document, or a key with much of the data, can be cut into time bins: `binned_overlap_join` meets on (key, bin), so the
rows of a hot key spread over as many tasks as it has bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import cols


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Strict on both sides: touching intervals do not overlap."""
    return (a_start < b_end) & (a_end > b_start)


def overlap_length(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def overlap_join(left: DataFrame, right: DataFrame, key: str, l: tuple[str, str], r: tuple[str, str], how: str = "inner") -> DataFrame:
    """Rows of left and right with the same key whose intervals overlap; semi and anti joins are `how`."""
    on = (left[key] == right[key]) & overlaps(left[l[0]], left[l[1]], right[r[0]], right[r[1]])
    joined = left.join(right, on, how)
    return joined if how.startswith("left_") else joined.drop(right[key])


def binned_overlap_join(left: DataFrame, right: DataFrame, key: str, l: tuple[str, str], r: tuple[str, str], width: int) -> DataFrame:
    """overlap_join by equality of (key, bin); a pair is made in the first bin that both intervals touch, and nowhere else."""

    def bins(df: DataFrame, at: tuple[str, str], name: str) -> DataFrame:
        first, last = F.floor(F.col(at[0]) / width), F.floor((F.col(at[1]) - 1) / width)
        return df.withColumn(name, F.explode(F.sequence(first, F.greatest(first, last))))

    a, b = bins(left, l, "_bin_l"), bins(right.withColumnRenamed(key, "_key_r"), r, "_bin_r")
    once = F.col("_bin_l") == F.greatest(F.floor(F.col(l[0]) / width), F.floor(F.col(r[0]) / width))
    on = (F.col(key) == F.col("_key_r")) & (F.col("_bin_l") == F.col("_bin_r")) & once & overlaps(F.col(l[0]), F.col(l[1]), F.col(r[0]), F.col(r[1]))
    return a.join(b, on).drop("_bin_l", "_bin_r", "_key_r")


def around(points: DataFrame, others: DataFrame, key: str, at: str, other_at: str, values: list[str]) -> DataFrame:
    """points with `_before` and `_after`: structs of the last other row not after a point and of the first one after it.

    One shuffle of both sides by key and a sort each way, never their pairs. Of other rows at one time the largest `values` are the one before
    and the smallest the one after; either is null where there is none.
    """
    mark = F.struct(*(F.col(v) for v in values))
    kind = others.select(mark.alias("m")).schema["m"].dataType
    l = points.select(F.struct(*points.columns).alias("_row"), F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_m"))
    r = others.select(F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.col(key).alias("_key"), F.col(other_at).alias("_at"), F.lit(0).alias("_side"), mark.alias("_m"))
    w = Window.partitionBy("_key").orderBy("_at", "_side", "_m")
    both = l.unionByName(r).withColumn("_before", F.last("_m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    down = Window.partitionBy("_key").orderBy(F.desc("_at"), F.desc("_side"), F.desc("_m")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_after", F.last("_m", ignorenulls=True).over(down)).where("_side = 1").select("_row.*", "_before", "_after")


def within(events: DataFrame, others: DataFrame, key: str, at: str, other_at: str, tolerance, how: str = "left_semi") -> DataFrame:
    """Rows that have (left_semi) or lack (left_anti) a row of the other side within `tolerance`, ends included.

    The nearest other rows on both sides tell. Rows without a key or a time have none.
    """
    met = around(events, others.where(F.col(other_at).isNotNull()), key, at, other_at, [other_at])
    near = F.coalesce(F.col(at) - F.col(f"_before.{other_at}") <= tolerance, F.lit(False)) | F.coalesce(F.col(f"_after.{other_at}") - F.col(at) <= tolerance, F.lit(False))
    near = near & F.col(key).isNotNull() & F.col(at).isNotNull()
    return met.where(near if how == "left_semi" else ~near).drop("_before", "_after")


def asof(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, values: list[str]) -> DataFrame:
    """Each left row with the latest right row not after it, by one sort instead of a range join.

    Both sides are stacked and a window carries the last right row on; right rows sort first at equal times. Left rows without
    a right row before them keep nulls. Of right rows at one time the largest values count.
    """
    mark = F.struct(*(F.col(v) for v in values))
    l = left.select(*left.columns, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(mark.alias("m")).schema["m"].dataType).alias("_row"))
    r = right.select(key, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), mark.alias("_row"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_at", "_side", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_last", F.last("_row", ignorenulls=True).over(w)).where("_side = 1")
    return found.select(*left.columns, *(F.col(f"_last.{v}").alias(v) for v in values))


def nearest_owner(points: DataFrame, owners: DataFrame, key: str, point_id: str, at: str, start: str, end: str, owner_id: str) -> DataFrame:
    """Each point's owner at the least (distance to [start, end], start, id); only owners of the same key are considered.

    A key's owners do not overlap, as islands do not, so the nearest is the last that begins before the point or the next.
    """
    met = around(points, owners, key, at, start, [start, end, owner_id])
    distance = lambda o: F.greatest(F.lit(0).cast("long"), F.col(f"{o}.{start}") - F.col(at), F.col(at) - F.col(f"{o}.{end}"))
    choice = lambda o: F.when(F.col(o).isNotNull(), F.struct(distance(o).alias("distance"), F.col(f"{o}.{start}").alias("s"), F.col(f"{o}.{owner_id}").alias("owner")))
    best = met.withColumn("b", F.least(choice("_before"), choice("_after"))).where("b is not null")
    return best.select(point_id, key, F.col("b.owner").alias(owner_id), F.col("b.distance").alias("distance"))


def clip_to_next(df: DataFrame, keys, start: str, end: str) -> DataFrame:
    """End every row at the next distinct start of its key at the latest."""
    starts = Window.partitionBy(*cols(keys)).orderBy(start).rangeBetween(1, Window.unboundedFollowing)
    return df.withColumn("clipped_end", F.least(F.col(end), F.min(start).over(starts)))


def extend_last(df: DataFrame, keys, group: str, start: str, end: str, order, reach) -> DataFrame:
    """The last row of every group goes on by `reach`, at most to the next row's start."""
    w = Window.partitionBy(*cols(keys)).orderBy(*cols(order))
    last = ~F.col(group).eqNullSafe(F.lead(group).over(w)) | F.lead(start).over(w).isNull()
    longer = F.least(F.col(end) + reach, F.coalesce(F.lead(start).over(w), F.col(end) + reach))
    return df.withColumn("extended_end", F.when(last, F.greatest(F.col(end), longer)).otherwise(F.col(end)))


def running_bounds(df: DataFrame, keys, start: str, end: str, order) -> DataFrame:
    """Latest end of all rows before and earliest start of all rows after."""
    w = Window.partitionBy(*cols(keys)).orderBy(*cols(order))
    return df.withColumn("max_end_before", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("min_start_after", F.min(start).over(w.rowsBetween(1, Window.unboundedFollowing)))


def cuts(runs: DataFrame, keys, start: str = "start", end: str = "end", least_rest=None) -> DataFrame:
    """Cuts between neighbouring runs: the middle of the gap. With `least_rest`, only gaps of at least that length."""
    w = Window.partitionBy(*cols(keys)).orderBy(start, end)
    nexts = F.lead(start).over(w)
    out = runs.withColumn("next_start", nexts).where("next_start is not null").withColumn("cut", F.floor((F.col(end) + F.col("next_start")) / 2))
    return out if least_rest is None else out.where(F.col("next_start") - F.col(end) >= least_rest)


def snap(points: DataFrame, rests: DataFrame, key: str, point_id: str, at: str, reach) -> DataFrame:
    """Move a point to the middle of the nearest rest within `reach`: least (distance, -length, middle); others stay."""
    middle = F.floor((F.col("rest_start") + F.col("rest_end")) / 2)
    longest = rests.select(key, middle.alias("_m"), (F.col("rest_start") - F.col("rest_end")).alias("_l")).groupBy(key, "_m").agg(F.min("_l").alias("_l"))
    met = around(points, longest, key, at, "_m", ["_m", "_l"])
    away = lambda o: F.abs(F.col(f"{o}._m") - F.col(at))
    choice = lambda o: F.when(away(o) <= reach, F.struct(away(o).alias("d"), F.col(f"{o}._l").alias("l"), F.col(f"{o}._m").alias("m")))
    return met.withColumn("snapped", F.coalesce(F.least(choice("_before"), choice("_after"))["m"], F.col(at))).drop("_before", "_after")


def subtract(minuend: DataFrame, subtrahend: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Parts (key, start, end) of the first intervals' union that no second interval covers, by one sweep over all ends."""

    def ends(df: DataFrame, a: int, b: int) -> DataFrame:
        return df.select(key, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(a).alias("p"), F.lit(b).alias("m")), F.struct(F.col(end).alias("t"), F.lit(-a).alias("p"), F.lit(-b).alias("m")))).alias("x")).select(key, "x.*")

    steps = ends(minuend, 1, 0).union(ends(subtrahend, 0, 1)).groupBy(key, "t").agg(F.sum("p").alias("p"), F.sum("m").alias("m"))
    w = Window.partitionBy(key).orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = steps.select(key, F.col("t").alias("start"), F.lead("t").over(w).alias("end"), F.sum("p").over(run).alias("p"), F.sum("m").over(run).alias("m")).where("p > 0 and m = 0")
    joined = pieces.withColumn("_new", F.when(F.col("start") == F.lag("end").over(Window.partitionBy(key).orderBy("start")), 0).otherwise(1))
    joined = joined.withColumn("_run", F.sum("_new").over(Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return joined.groupBy(key, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def split_by_weight(df: DataFrame, keys, start: str, end: str, weight: str, order) -> DataFrame:
    """Divide the interval that the rows of a key share in proportion to their weights, in order."""
    w = Window.partitionBy(*cols(keys)).orderBy(*cols(order))
    total = F.sum(weight).over(Window.partitionBy(*cols(keys)))
    through = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    length = F.col(end) - F.col(start)
    return df.withColumn("part_start", F.col(start) + length * (through - F.col(weight)) / total).withColumn("part_end", F.col(start) + length * through / total)


def measures(df: DataFrame, start: str, end: str, length: int) -> DataFrame:
    """Cut every interval at multiples of `length`; `tied` tells that the part goes on in the next measure."""
    first, last = F.floor(F.col(start) / length), F.floor((F.col(end) - 1) / length)
    parts = df.withColumn("measure", F.explode(F.sequence(first, F.greatest(first, last))))
    return parts.withColumn("part_start", F.greatest(F.col(start), F.col("measure") * length)).withColumn("part_end", F.least(F.col(end), (F.col("measure") + 1) * length)).withColumn("tied", F.col("measure") < last)


def tiles(df: DataFrame, start: str, end: str, length: int, context: int) -> DataFrame:
    """Windows of `length` that tile an interval, each with `context` on both sides inside the interval."""
    n = F.greatest(F.lit(1).cast("long"), F.ceil((F.col(end) - F.col(start)) / length))
    out = df.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    begin = F.col(start) + F.col("tile") * length
    return out.withColumn("tile_start", F.greatest(F.col(start), begin - context)).withColumn("tile_end", F.least(F.col(end), begin + length + context))


def grid(df: DataFrame, keys, start: str, end: str, half: int) -> DataFrame:
    """Distinct cells of a grid with step `half` that intervals touch; a cell owns [cell * half, (cell + 1) * half)."""
    first = F.floor(F.col(start) / half)
    return df.select(*cols(keys), F.explode(F.sequence(first, F.greatest(first, F.ceil(F.col(end) / half) - 1))).alias("cell")).distinct()

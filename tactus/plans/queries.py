"""Registered queries of the engine's operators over the star-schema tables, each with the SQL that states its result.

Times are whole microseconds, so results are exact. `spans` gives every event a length of one to eleven minutes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kana, sequences
from ..operators import decode, integrity, intervals, islands, selection, songs
from ..sources import scores
from ..streaming import sessions

MINUTE, HOUR = 60_000_000, 3_600_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SPANS = "(select user_id, event_id, event_type, value, epoch_us(ts) as s, epoch_us(ts) + 60000000 * (1 + event_id % 11) as e from events)"
LINES = "(select l_orderkey as k, l_linenumber as n, l_quantity as q, l_partkey as p, l_extendedprice as x from lineitem)"


def query(sql: str | None):
    """Register a function of (spark, sf_dir) with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{spans}", SPANS).replace("{lines}", LINES)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", micros.alias("s")).withColumn("e", F.col("s") + MINUTE * (1 + F.col("event_id") % 11))


ISLANDS = """, o as (select *, max(e) over w as b from {spans} window w as (partition by user_id order by s, event_id rows between unbounded preceding and 1 preceding)),
f as (select *, sum(case when b is null or s > b + {gap} then 1 else 0 end) over (partition by user_id order by s, event_id rows unbounded preceding)::bigint as island from o),
g as (select user_id, island, min(s) as "start", max(e) as "end", count(*) as n from f group by all)"""


def runs_sql(gap: int) -> str:
    return "with z as (select 1)" + ISLANDS.replace("{gap}", str(gap))


def runs(spark: SparkSession, sf_dir: str, gap: int) -> DataFrame:
    return islands.bounds(islands.islands(spans(spark, sf_dir), "user_id", "s", "e", ["s", "event_id"], gap), "user_id", "s", "e")


@query(runs_sql(24 * HOUR) + ' select * from g')
def gap_islands_user(spark, sf_dir):
    return runs(spark, sf_dir, 24 * HOUR)


@query(runs_sql(24 * HOUR) + ' select * from (select *, row_number() over (partition by user_id order by "start", "end") as rank from g where n >= 2) where rank <= 4')
def gap_islands_min_size(spark, sf_dir):
    return islands.first_runs(runs(spark, sf_dir, 24 * HOUR), "user_id", 2, 4)


@query(
    runs_sql(12 * HOUR)
    + """, a as (select user_id, "start", "end", n from g where n >= 1), b as (select *, max("end") over (partition by user_id order by "start", "end" rows between unbounded preceding and 1 preceding) as p from a),
c as (select *, sum(case when p is null or "start" > p + 172800000000 then 1 else 0 end) over (partition by user_id order by "start", "end" rows unbounded preceding)::bigint as island from b)
select user_id, island, min("start") as "start", max("end") as "end", sum(n)::bigint as n, count(*) as parts from c group by all having sum(n) >= 3"""
)
def two_level_islands(spark, sf_dir):
    return islands.two_level(spans(spark, sf_dir), "user_id", "s", "e", ["s", "event_id"], 12 * HOUR, 1, 48 * HOUR, 3)


@query("with a as {spans} select a.event_id as event_id, count(*) as n, sum(least(a.e, b.e) - greatest(a.s, b.s))::bigint as covered from a join a b on a.user_id = b.user_id and a.s < b.e and a.e > b.s group by a.event_id".replace("with a as {spans}", "with a as (select * from {spans})"))
def interval_overlap_join(spark, sf_dir):
    a = spans(spark, sf_dir)
    b = a.select("user_id", F.col("s").alias("s2"), F.col("e").alias("e2"))
    return intervals.overlap_join(a, b, "user_id", ("s", "e"), ("s2", "e2")).groupBy("event_id").agg(F.count("*").alias("n"), F.sum(intervals.overlap_length(F.col("s"), F.col("e"), F.col("s2"), F.col("e2"))).alias("covered"))


@query("with a as (select * from {spans}) select a.event_type as event_type, count(*) as n, sum(least(a.e, b.e) - greatest(a.s, b.s))::bigint as covered from a join a b on a.event_type = b.event_type and a.s < b.e and a.e > b.s group by a.event_type")
def binned_overlap_join(spark, sf_dir):
    a = spans(spark, sf_dir).select("event_type", "s", "e")
    b = a.select("event_type", F.col("s").alias("s2"), F.col("e").alias("e2"))
    met = intervals.binned_overlap_join(a, b, "event_type", ("s", "e"), ("s2", "e2"), 15 * MINUTE)
    return met.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(intervals.overlap_length(F.col("s"), F.col("e"), F.col("s2"), F.col("e2"))).alias("covered"))


@query(runs_sql(24 * HOUR) + ', m as (select user_id, event_id, (s + e) // 2 as mid from {spans}) select g.user_id, g.island, count(m.event_id) as events, count(*) filter (m.mid - g."start" < 3600000000) as early from g join m on g.user_id = m.user_id and m.mid >= g."start" and m.mid < g."end" group by all')
def point_in_interval_counts(spark, sf_dir):
    mids = spans(spark, sf_dir).select("user_id", "event_id", F.floor((F.col("s") + F.col("e")) / 2).alias("mid")).withColumnRenamed("user_id", "u")
    g = runs(spark, sf_dir, 24 * HOUR).select("user_id", "island", F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    met = intervals.asof(mids, g.withColumnRenamed("user_id", "u"), "u", "mid", "g_start", ["g_start", "g_end", "island"]).where("mid < g_end")
    return met.groupBy(F.col("u").alias("user_id"), "island").agg(F.count("event_id").alias("events"), F.count_if(F.col("mid") - F.col("g_start") < HOUR).alias("early"))


NEAR = "with a as (select * from {spans}) select event_id, user_id, s from a where event_type = (select max(event_type) from a) and {exists} exists (select 1 from a b where b.user_id = a.user_id and b.event_type <> a.event_type and b.s >= a.s - 43200000000 and b.s <= a.s + 43200000000)"


def near(spark, sf_dir, how):
    a = spans(spark, sf_dir).select("event_id", "user_id", "event_type", "s")
    most = a.agg(F.max("event_type").alias("m"))
    one = a.join(F.broadcast(most), F.col("event_type") == F.col("m"))
    others = a.join(F.broadcast(most), F.col("event_type") == F.col("m"), "left_anti").select("user_id", F.col("s").alias("t"))
    return intervals.within(one, others, "user_id", "s", "t", 12 * HOUR, how).select("event_id", "user_id", "s")


@query(NEAR.replace("{exists}", ""))
def tolerance_semi_join(spark, sf_dir):
    return near(spark, sf_dir, "left_semi")


@query(NEAR.replace("{exists}", "not"))
def uncovered_anti_join(spark, sf_dir):
    return near(spark, sf_dir, "left_anti")


@query("with a as (select * from {spans}), p as (select user_id, s as t, max(value) as value from a where event_id % 3 = 0 group by all) select a.event_id, a.user_id, p.t as t, p.value as value from (select * from a where event_id % 3 <> 0) a asof left join p on a.user_id = p.user_id and a.s >= p.t")
def asof_owner(spark, sf_dir):
    a = spans(spark, sf_dir)
    left = a.where("event_id % 3 <> 0").select("event_id", "user_id", "s")
    right = a.where("event_id % 3 = 0").select("user_id", F.col("s").alias("t"), "value")
    return intervals.asof(left, right, "user_id", "s", "t", ["t", "value"]).select("event_id", "user_id", "t", "value")


@query(runs_sql(24 * HOUR) + ', d as (select a.event_id, a.user_id, g.island, greatest(0, g."start" - a.s, a.s - g."end") as distance, g."start" as st from {spans} a join g on a.user_id = g.user_id where g.n >= 2), r as (select *, row_number() over (partition by event_id order by distance, st, island) as rn from d) select event_id, user_id, island, distance::bigint as distance from r where rn = 1')
def nearest_owner_min_by(spark, sf_dir):
    points = spans(spark, sf_dir).select("event_id", "user_id", "s")
    return intervals.nearest_owner(points, runs(spark, sf_dir, 24 * HOUR).where("n >= 2"), "user_id", "event_id", "s", "start", "end", "island")


@query(runs_sql(24 * HOUR) + ', c as (select user_id, island, "end", lead("start") over (partition by user_id order by "start", "end") as nx from g) select user_id, island, nx as next_start, ("end" + nx) // 2 as cut from c where nx is not null')
def cut_midpoints(spark, sf_dir):
    return intervals.cuts(runs(spark, sf_dir, 24 * HOUR), "user_id").select("user_id", "island", "next_start", "cut")


@query(runs_sql(24 * HOUR) + ', c as (select user_id, "end" as a, lead("start") over (partition by user_id order by "start", "end") as b from g), p as (select user_id, event_id, s from {spans}), d as (select p.event_id, p.user_id, p.s, abs((c.a + c.b) // 2 - p.s) as dist, c.a - c.b as l, (c.a + c.b) // 2 as m from p join c on p.user_id = c.user_id where c.b is not null and abs((c.a + c.b) // 2 - p.s) <= 172800000000), r as (select *, row_number() over (partition by event_id order by dist, l, m) as rn from d) select p.event_id, p.user_id, p.s, coalesce(r.m, p.s) as snapped from p left join r on p.event_id = r.event_id and r.rn = 1')
def snap_to_rest(spark, sf_dir):
    points = spans(spark, sf_dir).select("user_id", "event_id", "s")
    rests = intervals.cuts(runs(spark, sf_dir, 24 * HOUR), "user_id").select("user_id", F.col("end").alias("rest_start"), F.col("next_start").alias("rest_end"))
    return intervals.snap(points, rests, "user_id", "event_id", "s", 48 * HOUR)


@query("select user_id, event_id, max(e) over (partition by user_id order by s, event_id rows between unbounded preceding and 1 preceding) as max_end_before, min(s) over (partition by user_id order by s, event_id rows between 1 following and unbounded following) as min_start_after from {spans}")
def running_bounds(spark, sf_dir):
    return intervals.running_bounds(spans(spark, sf_dir), "user_id", "s", "e", ["s", "event_id"]).select("user_id", "event_id", "max_end_before", "min_start_after")


@query("with a as (select *, lead(event_type) over w as nt, lead(s) over w as ns from {spans} window w as (partition by user_id order by s, event_id)) select user_id, event_id, case when ns is null or nt is distinct from event_type then greatest(e, least(e + 3600000000, coalesce(ns, e + 3600000000))) else e end as extended_end from a")
def tail_extend(spark, sf_dir):
    return intervals.extend_last(spans(spark, sf_dir), "user_id", "event_type", "s", "e", ["s", "event_id"], HOUR).select("user_id", "event_id", "extended_end")


@query("select user_id, event_id, least(e, min(s) over (partition by user_id order by s range between 1 following and unbounded following)) as clipped_end from {spans}")
def overlap_clip(spark, sf_dir):
    return intervals.clip_to_next(spans(spark, sf_dir), "user_id", "s", "e").select("user_id", "event_id", "clipped_end")


@query(
    """with o as (select *, max(e) over w as b, lag(event_type) over v as pt from {spans} window w as (partition by user_id order by s, event_id rows between unbounded preceding and 1 preceding), v as (partition by user_id order by s, event_id)),
f as (select *, sum(case when b is null or s > b + 86400000000 or pt is distinct from event_type then 1 else 0 end) over (partition by user_id order by s, event_id rows unbounded preceding)::bigint as island from o)
select user_id, island, min(s) as "start", max(e) as "end", count(*) as n from f group by all"""
)
def coalesce_same_key(spark, sf_dir):
    rows = islands.islands(spans(spark, sf_dir), "user_id", "s", "e", ["s", "event_id"], 24 * HOUR, same=["event_type"])
    return islands.bounds(rows, "user_id", "s", "e")


MERGED = """with o as (select event_type, s, e, max(e) over (partition by event_type order by s, e rows between unbounded preceding and 1 preceding) as b from {spans} {where}),
f as (select *, sum(case when b is null or s > b + {gap} then 1 else 0 end) over (partition by event_type order by s, e rows unbounded preceding)::bigint as island from o),
u as (select event_type, island, min(s) as s, max(e) as e, count(*) as n from f group by all)"""


@query(MERGED.replace("{where}", "").replace("{gap}", "120000000") + ' select event_type, island, s as "start", e as "end", n from u')
def interval_union(spark, sf_dir):
    return islands.merged(spans(spark, sf_dir), "event_type", "s", "e", 2 * MINUTE)


@query(
    """with x as (select event_type, s as t, case when event_id % 2 = 0 then 1 else 0 end as p, case when event_id % 2 = 1 then 1 else 0 end as m from {spans} union all select event_type, e, case when event_id % 2 = 0 then -1 else 0 end, case when event_id % 2 = 1 then -1 else 0 end from {spans}),
y as (select event_type, t, sum(p) as p, sum(m) as m from x group by all),
z as (select event_type, t as s, lead(t) over (partition by event_type order by t) as e, sum(p) over (partition by event_type order by t rows unbounded preceding) as p, sum(m) over (partition by event_type order by t rows unbounded preceding) as m from y),
k as (select event_type, s, e from z where p > 0 and m = 0),
f as (select *, sum(case when s = pe then 0 else 1 end) over (partition by event_type order by s rows unbounded preceding) as r from (select *, lag(e) over (partition by event_type order by s) as pe from k))
select event_type, min(s) as "start", max(e) as "end" from f group by event_type, r"""
)
def interval_subtract(spark, sf_dir):
    a = spans(spark, sf_dir)
    return intervals.subtract(a.where("event_id % 2 = 0"), a.where("event_id % 2 = 1"), "event_type", "s", "e")


@query("with a as (select k, n, p, q, sum(q) over (partition by k) as total, sum(q) over (partition by k order by n, p, x rows unbounded preceding) as thru from {lines}) select k, n, p, round(1000.0 * (thru - q) / total, 6) as part_start, round(1000.0 * thru / total, 6) as part_end from a")
def stack_split_proportional(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_partkey").alias("p"), F.col("l_extendedprice").alias("x")).withColumn("s", F.lit(0.0)).withColumn("e", F.lit(1000.0))
    out = intervals.split_by_weight(rows, "k", "s", "e", "q", ["n", "p", "x"])
    return out.select("k", "n", "p", F.round("part_start", 6).alias("part_start"), F.round("part_end", 6).alias("part_end"))


@query("select event_type, round(quantile_cont(value, 0.9), 6) as p90, count(*) as n, bool_and(value >= 0) as all_positive, quantile_cont(value, 0.9) >= 50 as supported from events group by event_type")
def exact_percentile_gate(spark, sf_dir):
    p90 = F.percentile("value", 0.9)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(p90, 6).alias("p90"), F.count("*").alias("n"), F.bool_and(F.col("value") >= 0).alias("all_positive"), (p90 >= 50).alias("supported"))


@query("select o_orderpriority, round(median(o_totalprice), 4) as median_price, count(*) as n, median(o_totalprice) >= 150000 as kept from orders group by all")
def median_gate(spark, sf_dir):
    m = F.median("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(m, 4).alias("median_price"), F.count("*").alias("n"), (m >= 150000).alias("kept"))


@query("select l_returnflag, l_linestatus, round(exp(avg(ln(greatest(l_quantity, 1e-30)))), 6) as geometric_mean, count(*) as n from lineitem group by all")
def geometric_mean(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.exp(F.avg(F.log(F.greatest("l_quantity", F.lit(1e-30))))), 6).alias("geometric_mean"), F.count("*").alias("n"))


@query("with a as (select p_brand, p_partkey, p_retailprice / 100 as c from part), b as (select *, exp(min(c) over (partition by p_brand) - c) as x from a) select p_brand, p_partkey, round(x / sum(x) over (partition by p_brand), 9) as probability from b")
def softmax_alternatives(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_retailprice") / 100).alias("c"))
    return selection.softmax(rows, "p_brand", "c").select("p_brand", "p_partkey", F.round("probability", 9).alias("probability"))


@query("with a as (select s_nationkey, s_acctbal, row_number() over (partition by s_nationkey order by s_acctbal) as r from supplier), b as (select s_nationkey, max(case when r = 1 then s_acctbal end) as c1, max(case when r = 2 then s_acctbal end) as c2 from a group by all) select s_nationkey, c1 as cost, round(case when c2 is null then 1.0 else (c2 - c1) / (c2 - c1 + 1) end, 9) as confidence from b")
def margin_confidence(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_acctbal").alias("c"))
    return selection.margin(rows, "s_nationkey", "c").select("s_nationkey", "cost", F.round("confidence", 9).alias("confidence"))


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderdate, o_orderkey) as r from orders) where r = 1")
def arg_best_tiebreak(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return selection.best_row(rows, "o_custkey", [-F.col("o_totalprice"), F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("with a as (select user_id, event_type, min((s, event_id)) as f from {spans} group by all) select user_id, event_type, row_number() over (partition by user_id order by f) as place from a")
def distinct_keep_first(spark, sf_dir):
    return selection.first_distinct(spans(spark, sf_dir), "user_id", "event_type", ["s", "event_id"])


@query("with a as (select user_id, event_type, count(*) as n, min((s, event_id)) as f from {spans} group by all) select user_id, event_type, n from (select *, row_number() over (partition by user_id order by n desc, f) as r from a) where r = 1")
def mode_first_seen(spark, sf_dir):
    return selection.mode_first(spans(spark, sf_dir), "user_id", "event_type", ["s", "event_id"]).select("user_id", "event_type", "n")


@query(
    """with v as (select l_suppkey % 10 as view, l_partkey % 7 as opt, l_orderkey % 50 as k, sum(l_quantity) as d from lineitem group by all), b as (select k, view, d as base from v where opt = 0),
j as (select v.k, v.opt, sum(v.d) as total, sum(b.base) as base, max(v.d > b.base) as worse from v join b on v.k = b.k and v.view = b.view where opt <> 0 group by all),
w as (select *, case when total >= base then 'default_best' when worse then 'view_conflict' when base - total < 5 then 'no_gain' else 'chosen' end as reason from j),
r as (select *, row_number() over (partition by k order by case reason when 'chosen' then 0 when 'no_gain' then 1 when 'view_conflict' then 2 else 3 end, total, opt) as rn from w)
select d.k, case when r.reason = 'chosen' then r.opt else 0 end as opt, coalesce(r.reason, 'only_default') as reason from (select distinct k from v where opt = 0) d left join r on d.k = r.k and r.rn = 1"""
)
def consensus_choice(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("view"), (F.col("l_partkey") % 7).alias("opt"), (F.col("l_orderkey") % 50).alias("k")).agg(F.sum("l_quantity").alias("d"))
    return selection.consensus(rows, "k", "opt", "view", "d", F.col("opt") == 0, 5)


@query("with a as (select s_nationkey as k, s_suppkey as i, s_acctbal as v from supplier), m as (select a.k, a.i, avg(1 / (1 + abs(a.v - b.v))) as g from a join a b on a.k = b.k and a.i <> b.i group by all) select k, i, round(g, 9) as agreement from (select *, row_number() over (partition by k order by g desc, i) as r from m) where r = 1")
def medoid_supplier(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))
    return selection.medoid(rows, "k", "i", 1 / (1 + F.abs(F.col("a.v") - F.col("b.v")))).select("k", "i", F.round("agreement", 9).alias("agreement"))


@query(
    """select 'customer' as rule, cast(o_orderkey as varchar) as owner, cast(o_custkey as varchar) as detail from orders where o_custkey not in (select c_custkey from customer where c_custkey % 97 <> 0)
union all select 'quantity', cast(l_orderkey as varchar), cast(l_linenumber as varchar) from lineitem where not (l_quantity between 1 and 49)
union all select 'duplicate', cast(l_partkey as varchar) || '/' || cast(l_suppkey as varchar), cast(count(*) as varchar) from lineitem group by l_partkey, l_suppkey having count(*) > 1"""
)
def ref_integrity_violations(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    rules = [
        integrity.resolves(table(spark, sf_dir, "orders"), "customer", "o_orderkey", "o_custkey", table(spark, sf_dir, "customer").where("c_custkey % 97 <> 0"), "c_custkey"),
        integrity.broken(line, "quantity", "l_orderkey", F.col("l_quantity").between(1, 49), F.col("l_linenumber")),
        integrity.unique(line, "duplicate", ["l_partkey", "l_suppkey"]),
    ]
    return rules[0].unionByName(rules[1]).unionByName(rules[2])


@query("select 'overlap' as rule, cast(user_id as varchar) as owner, cast(s as varchar) as detail from (select *, lag(e) over (partition by user_id order by s, event_id) as b from {spans}) where s < b - 0")
def monotone_violations(spark, sf_dir):
    return integrity.ordered(spans(spark, sf_dir), "overlap", "user_id", ["s", "event_id"], "s", "e", 0)


@query(
    """with a as (select distinct o_custkey as k from orders where o_orderstatus = 'O'), b as (select distinct o_custkey as k from orders where o_orderstatus = 'F'), h as (select k, 'filled' as p from b union all select k, 'open' from a)
select 'partition' as rule, cast(coalesce(c.c_custkey, h.k) as varchar) as owner, coalesce(string_agg(p, '+' order by p), '') as detail from customer c full join h on c.c_custkey = h.k group by coalesce(c.c_custkey, h.k), c.c_custkey having c.c_custkey is null or count(p) <> 1"""
)
def coverage_partition(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return integrity.partition(table(spark, sf_dir, "customer"), {"open": orders.where("o_orderstatus = 'O'"), "filled": orders.where("o_orderstatus = 'F'")}, "partition", "c_custkey")


@query(
    """select 'reciprocal' as rule, cast(k as varchar) as owner, side || ':' || cast(v as varchar) as detail from (
select k, v, 'left' as side from (select distinct l_suppkey as k, l_partkey as v from lineitem where l_quantity > 25 except select distinct l_suppkey, l_partkey from lineitem where l_discount > 0.05)
union all select k, v, 'right' from (select distinct l_suppkey as k, l_partkey as v from lineitem where l_discount > 0.05 except select distinct l_suppkey, l_partkey from lineitem where l_quantity > 25))"""
)
def reciprocal_edges(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return integrity.reciprocal(line.where("l_quantity > 25"), line.where("l_discount > 0.05"), "reciprocal", "l_suppkey", "l_partkey")


@query("with r as (select user_id, event_id, event_type, row_number() over (partition by user_id order by s, event_id) as pos, lag(event_type) over (partition by user_id order by s, event_id) as p from {spans}), f as (select *, sum(case when p is not distinct from event_type then 0 else 1 end) over (partition by user_id order by pos rows unbounded preceding)::bigint as run from r) select user_id, run, event_type, min(pos) as first, max(pos) as last, count(*) as n from f group by all")
def rle_collapse(spark, sf_dir):
    return islands.run_lengths(spans(spark, sf_dir), "user_id", "event_type", ["s", "event_id"])


@query("select event_id, m as measure, greatest(s, m * 240000000) as part_start, least(e, (m + 1) * 240000000) as part_end, m < (e - 1) // 240000000 as tied from (select *, unnest(range(s // 240000000, (e - 1) // 240000000 + 1)) as m from {spans})")
def measure_split(spark, sf_dir):
    return intervals.measures(spans(spark, sf_dir), "s", "e", 4 * MINUTE).select("event_id", "measure", "part_start", "part_end", "tied")


@query(runs_sql(24 * HOUR) + ' select user_id, island, t as tile, greatest("start", "start" + t * 14400000000 - 900000000) as tile_start, least("end", "start" + (t + 1) * 14400000000 + 900000000) as tile_end from (select *, unnest(range(greatest(1, -((-("end" - "start")) // 14400000000)))) as t from (select user_id, island, "start", "end", n from g where n >= 2))'.replace('-((-("end" - "start")) // 14400000000)', '("end" - "start" + 14400000000 - 1) // 14400000000'))
def tiling_windows(spark, sf_dir):
    g = runs(spark, sf_dir, 24 * HOUR).where("n >= 2")
    return intervals.tiles(g, "start", "end", 4 * HOUR, 15 * MINUTE).select("user_id", "island", "tile", "tile_start", "tile_end")


@query("select distinct user_id, unnest(range(s // 180000000, greatest(s // 180000000, (e + 179999999) // 180000000 - 1) + 1)) as cell from {spans}")
def grid_cells(spark, sf_dir):
    return intervals.grid(spans(spark, sf_dir), "user_id", "s", "e", 3 * MINUTE)


@query("with recursive r as (select conv_id, turn, role, lower(text) as t from conversations), c as (select conv_id, turn, contains(t, 'idiot') or length(t) < 40 as seed, length(t) < 120 as can from r), n as (select *, (seed or can) and coalesce(lag(seed or can) over (partition by conv_id order by turn), false) as j from c), f as (select *, sum(case when j then 0 else 1 end) over (partition by conv_id order by turn rows unbounded preceding) as run from n) select conv_id, turn, (seed or can) and max(seed::int) over (partition by conv_id, run) = 1 as labelled from f")
def credit_propagation(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("t", F.lower("text"))
    return islands.propagate(rows, "conv_id", "turn", F.contains("t", F.lit("idiot")) | (F.length("t") < 40), F.length("t") < 120).select("conv_id", "turn", "labelled")


@query("select doc_id, lang, regexp_matches(text, '\\p{L}') and regexp_full_match(text, '(?s)(?:\\P{L}|\\p{Latin})*') as latin from documents")
def latin_text_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", kana.latin_only(F.col("text")).alias("latin"))


FAMILIES = {"license": r"released under the .* licen[sc]e\.?", "greeting": r"(?:hello|hi|welcome)\b.*", "shout": r"[^a-z]*!![^a-z]*"}


@query(
    "with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents), c as (select doc_id, case when regexp_full_match(lower(line), 'released under the .* licen[sc]e\\.?') then 'license' when regexp_full_match(lower(line), '(?:hello|hi|welcome)\\b.*') then 'greeting' when regexp_full_match(line, '[^a-z]*!![^a-z]*') then 'shout' end as family from l) select doc_id, family, count(*) as n from c where family is not null group by all"
)
def template_family(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    family = F.lit(None).cast("string")
    for name, pattern in reversed(FAMILIES.items()):
        family = F.when((F.col("line") if name == "shout" else F.lower("line")).rlike(f"^(?:{pattern})$"), name).otherwise(family)
    return lines.select("doc_id", family.alias("family")).where("family is not null").groupBy("doc_id", "family").agg(F.count("*").alias("n"))


@query(
    "with l as (select distinct unnest(string_split(replace(lower(text), chr(10), ' '), ' ')) as line from documents), k as (select line, unnest(range(1, 17)) as k from l where length(line) > 0), g as (select line, max(k) as n from k where length(line) % k = 0 and repeat(substr(line, 1, (length(line) // k)::bigint), k) = line group by line) select md5(line) as line, n::int as n from g where n > 1"
)
def repeat_unit(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[ \n]")).alias("line")).where(F.length("line") > 0).distinct()
    return words.withColumn("n", kana.repeat_unit(F.col("line"))).where("n > 1").select(F.md5(F.col("line").cast("binary")).alias("line"), "n")


TURNS = "(select conv_id, turn, coalesce(text, '') as x, coalesce(lag(text) over (partition by conv_id order by turn), '') as y from conversations)"


def turns(spark, sf_dir):
    """Every message with the one before it, byte by byte, as DuckDB counts."""
    data = lambda c: F.decode(F.encode(F.coalesce(c, F.lit("")), "UTF-8"), "ISO-8859-1")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", data(F.col("text")).alias("x"), data(before).alias("y"))


@query(f"select conv_id, turn, levenshtein(x, y)::int as distance from {TURNS}")
def edit_distance_pairs(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.levenshtein("x", "y").alias("distance"))


@query(f"select conv_id, turn, round(levenshtein(x, y) / greatest(strlen(x), strlen(y), 1), 9) as distance from {TURNS}")
def normalized_distance(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.round(sequences.normalized_distance(F.col("x"), F.col("y")), 9).alias("distance"))


STAMPS = "with c as (select event_id, greatest(round_even(value * 1000, 0)::bigint, 0) as ms from events)"


@query(STAMPS + " select event_id, case when ms // 3600000 < 100 then lpad((ms // 3600000)::varchar, 2, '0') else (ms // 3600000)::varchar end || ':' || lpad((ms // 60000 % 60)::varchar, 2, '0') || ':' || lpad((ms // 1000 % 60)::varchar, 2, '0') || ',' || lpad((ms % 1000)::varchar, 3, '0') as cue from c")
def srt_cues(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scores.stamp(F.col("value"), True).alias("cue"))


@query(STAMPS + " select event_id, case when ms // 60000 < 100 then lpad((ms // 60000)::varchar, 2, '0') else (ms // 60000)::varchar end || ':' || lpad((ms // 1000 % 60)::varchar, 2, '0') || '.' || lpad((ms // 10 % 100)::varchar, 2, '0') as cue from c")
def lrc_cues(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scores.stamp(F.col("value"), False).alias("cue"))


@query('with g as (select user_id, event_id, s from {spans}), o as (select *, lag(s) over (partition by user_id order by s, event_id) as b from g), f as (select *, sum(case when b is null or s > b + 3600000000 then 1 else 0 end) over (partition by user_id order by s, event_id rows unbounded preceding) as r from o) select user_id, min(s) as "start", max(s) as "end", count(*) as n from f group by user_id, r')
def session_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    micros = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({c} as timestamp_ntz))").alias(c)
    return sessions.sessions(rows, "user_id", "ts", "1 hour", "1 day").select("user_id", micros("start"), micros("end"), "n")


@query("with t as (select event_type, stddev_pop(value) as sd from events group by all), e as (select event_id, event_type, value, lag(value) over w as b, lead(value) over w as a from events window w as (partition by event_type order by ts, event_id)) select event_type, count(*) as peaks from e where value > b and value >= a group by all")
def local_peaks(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("b", F.lag("value").over(w)).withColumn("a", F.lead("value").over(w))
    return rows.where((F.col("value") > F.col("b")) & (F.col("value") >= F.col("a"))).groupBy("event_type").agg(F.count("*").alias("peaks"))


@query("select l_orderkey, l_partkey from lineitem where l_returnflag = 'R' except select l_orderkey, l_partkey from lineitem where l_discount > 0.08")
def set_difference(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey").subtract(line.where("l_discount > 0.08").select("l_orderkey", "l_partkey"))


@query("select l_orderkey, l_partkey from lineitem where l_returnflag = 'R' intersect select l_orderkey, l_partkey from lineitem where l_discount > 0.08")
def set_intersection(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey").intersect(line.where("l_discount > 0.08").select("l_orderkey", "l_partkey"))


@query("select l_returnflag, l_linestatus, sum(l_quantity) as quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
def rollup_totals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query(None)
def decode_note_runs(spark, sf_dir):
    """Users' events as phrases: every third event is a unit, every event a note."""
    base = spans(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("s", "event_id"))).withColumn("phrase_id", F.floor((F.col("pos") - 1) / 6))
    first = F.min("s").over(Window.partitionBy("user_id", "phrase_id"))
    rows = base.withColumn("t", (F.col("s") - first) / HOUR).withColumn("doc_id", F.col("user_id").cast("string"))
    notes = rows.select("doc_id", "phrase_id", "pos", F.col("t").alias("start_sec"), (F.col("t") + 0.2).alias("end_sec"), (60 + F.col("event_id") % 5).cast("int").alias("pitch"))
    units = rows.where("pos % 3 = 1").select("doc_id", "phrase_id", "pos", (F.col("t") + 0.01).alias("onset"))
    return decode.decode_phrases(units, notes)


@query(None)
def block_similarity(spark, sf_dir):
    """Every document and item of which neither is more than twice as long, by their whole texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("x"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), d.rdd.getNumPartitions())  # few bytes are much work here
    d = d.repartition(parts, "x").groupBy("x").agg(F.collect_list("doc_id").alias("doc_ids"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("y"))
    near = d.join(F.broadcast(b), F.least(F.length("x"), F.length("y")) * 2 >= F.greatest(F.length("x"), F.length("y")))
    return near.select("doc_ids", "item_id", F.round(sequences.similarity("x", "y"), 9).alias("ratio")).select(F.explode("doc_ids").alias("doc_id"), "item_id", "ratio")


#: Users as songs, islands of a day as lines, events as notes and moras; times in hours. A mora's confidence follows its value.
SONGS = """, l as (select user_id::varchar as doc_id, island as line_index, "start" / 3.6e9 as start_sec, "end" / 3.6e9 as end_sec from g),
m as (select f.user_id::varchar as doc_id, island as line_index, event_id, s / 3.6e9 as start_sec, e / 3.6e9 as end_sec, case event_id % 7 when 0 then 1e-6 when 1 then null else 1.0 / (1 + abs(value) * (event_id % 5) * 20) end as confidence from f)"""


def song_lines(spark, sf_dir) -> DataFrame:
    g = runs(spark, sf_dir, 24 * HOUR)
    return g.select(F.col("user_id").cast("string").alias("doc_id"), F.col("island").alias("line_index"), (F.col("start") / 3.6e9).alias("start_sec"), (F.col("end") / 3.6e9).alias("end_sec"))


def song_moras(spark, sf_dir) -> DataFrame:
    rows = islands.islands(spans(spark, sf_dir), "user_id", "s", "e", ["s", "event_id"], 24 * HOUR)
    kind = F.col("event_id") % 7
    confidence = F.when(kind == 0, 1e-6).when(kind == 1, F.lit(None)).otherwise(1.0 / (1 + F.abs("value") * (F.col("event_id") % 5) * 20))
    return rows.select(F.col("user_id").cast("string").alias("doc_id"), F.col("island").alias("line_index"), "event_id", (F.col("s") / 3.6e9).alias("start_sec"), (F.col("e") / 3.6e9).alias("end_sec"), confidence.alias("confidence"))


@query(runs_sql(24 * HOUR) + SONGS + " select doc_id, line_index, round(exp(avg(ln(greatest(confidence, 1e-30)))), 9) as quality, coalesce(min(confidence) >= 1e-5 and exp(avg(ln(greatest(confidence, 1e-30)))) >= 7.5e-4, false) as verified from (select doc_id, line_index, coalesce(confidence, 1e-30) as c0, confidence from m) where confidence is not null group by all")
def verified_lines(spark, sf_dir):
    rows = songs.verified(song_moras(spark, sf_dir).where("confidence is not null"))
    return rows.select("doc_id", "line_index", F.round("quality", 9).alias("quality"), "verified")


@query(runs_sql(24 * HOUR) + SONGS + " select doc_id, line_index, event_id, coalesce(start_sec is not null and confidence >= 1e-5, false) as usable from m")
def usable_boundaries(spark, sf_dir):
    return song_moras(spark, sf_dir).select("doc_id", "line_index", "event_id", songs.usable(F.col("start_sec"), F.col("confidence")).alias("usable"))


@query("select doc_id, coalesce(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 4 and 2 * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= length(regexp_replace(text, '\\P{L}', '', 'g')), false) as is_foreign from documents")
def foreign_text_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(songs.foreign_text(F.col("text")), F.lit(False)).alias("is_foreign"))


@query("with a as (select user_id, event_id, event_type, s / 3.6e9 as b, e / 3.6e9 as c from {spans}) select user_id, event_id from a where event_type = (select min(event_type) from a) and exists (select 1 from a n where n.user_id = a.user_id and n.event_type = (select max(event_type) from a) and a.b < n.c + 0.12 and a.c > n.b - 0.12)")
def phonetic_cover(spark, sf_dir):
    rows = spans(spark, sf_dir).select(F.col("user_id").alias("doc_id"), "event_id", "event_type", (F.col("s") / 3.6e9).alias("start_sec"), (F.col("e") / 3.6e9).alias("end_sec"))
    ends = rows.agg(F.min("event_type").alias("first"), F.max("event_type").alias("last"))
    of = lambda c: rows.join(F.broadcast(ends), F.col("event_type") == F.col(c)).drop("first", "last")
    return songs.phonetic_cover(of("first"), of("last")).select(F.col("doc_id").alias("user_id"), "event_id")


@query("with a as (select user_id::varchar as doc_id, event_type as text, greatest(round_even(s / 1000 - min(s) over (partition by user_id) / 1000, 0)::bigint, 0) as b from {spans}), c as (select *, row_number() over (partition by doc_id order by b, text) as i, b + 1500 as e from a), k as (select doc_id, i, text, [case when t // 3600000 < 100 then lpad((t // 3600000)::varchar, 2, '0') else (t // 3600000)::varchar end || ':' || lpad((t // 60000 % 60)::varchar, 2, '0') || ':' || lpad((t // 1000 % 60)::varchar, 2, '0') || ',' || lpad((t % 1000)::varchar, 3, '0') for t in [b, e]] as w from c) select doc_id, md5(string_agg(i::varchar || chr(10) || w[1] || ' --> ' || w[2] || chr(10) || text, chr(10) || chr(10) order by i) || chr(10)) as srt from k group by doc_id")
def srt_documents(spark, sf_dir):
    """A user's events as a subtitle file, one and a half seconds each from the user's first event on."""
    first = F.min("s").over(Window.partitionBy("user_id"))
    rows = spans(spark, sf_dir).withColumn("ms", F.bround(F.col("s") / 1000 - first / 1000, 0))
    cues = rows.select(F.col("user_id").cast("string").alias("doc_id"), (F.col("ms") / 1000).alias("start_sec"), ((F.col("ms") + 1500) / 1000).alias("end_sec"), F.col("event_type").alias("text"))
    return scores.srt(cues).select("doc_id", F.md5(F.col("srt").cast("binary")).alias("srt"))

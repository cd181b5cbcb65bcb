"""Generic extras beside the labelling operators: sessions, sliding windows, as-of and range joins, running frames, cubes.

as_of is a union and a running last value, so it sorts each key once and needs no inequality join. range_join matches points to intervals by buckets of the
interval length, so it is an equi-join with a residual test."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.runtime import table


def sessions(events: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """(key, session, n, first_at, last_at): runs of events at most gap_seconds apart."""
    w = Window.partitionBy(key).orderBy(at, "event_id")
    gap = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))) > gap_seconds * 1_000_000
    s = events.withColumn("session", F.sum(F.coalesce(gap.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(key, "session").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the latest `value` of right at or before its time, per key. value may not be a column of left."""
    cols = left.columns
    a = left.withColumn(value, F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    b = right.select(*[F.col(c) if c in (key, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], value).withColumn("_side", F.lit(0))
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_side = 1").drop("_side")


def range_join(points: DataFrame, at: str, spans: DataFrame, start: str, end: str, bucket: float) -> DataFrame:
    """Pairs with start <= at < end: spans are listed under each bucket they touch, points under their own."""
    p = points.withColumn("_b", F.floor(F.col(at) / bucket))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    return p.join(s, "_b").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")


def _e(s, d):
    return table(s, d, "events")


def q_sessions(s: SparkSession, d: str) -> DataFrame:
    return sessions(_e(s, d), "user_id", "ts", 6 * 3600)


def q_as_of(s, d):
    e = _e(s, d)
    price = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return as_of(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), price, "user_id", "ts", "last_value").select("event_id", "last_value")


def q_range(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_acctbal")
    bands = table(s, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 400.0 - 1000).alias("lo"), (F.col("n_nationkey") * 400.0 - 400).alias("hi"))
    return range_join(c, "c_acctbal", bands, "lo", "hi", 600.0).groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"))


def q_cube(s, d):
    o = table(s, d, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("o_custkey", 0.01).alias("_a"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().alias("gid")).drop("_a")


def q_running(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(s, d, "orders").select("o_orderkey", F.round(F.avg("o_totalprice").over(w.rowsBetween(-2, 0)), 4).alias("mean3"), F.lag("o_orderkey").over(w).alias("before"))


def q_revenue(s, d):
    l, o, c = table(s, d, "lineitem"), table(s, d, "orders"), table(s, d, "customer")
    n, r = table(s, d, "nation"), table(s, d, "region")
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


QUERIES = {"event_sessions": q_sessions, "as_of_join": q_as_of, "range_join": q_range, "order_cube": q_cube, "running_frame": q_running, "revenue_by_nation": q_revenue}
ORACLES = {
    "event_sessions": "with g as (select *, coalesce((epoch_us(ts) - epoch_us(lag(ts) over w) > 21600000000)::int, 0) b from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint \"session\" from g) select user_id, \"session\", count(*) n, min(ts) first_at, max(ts) last_at from s group by all",
    "as_of_join": "with p as (select user_id, ts, max(\"value\") last_value from events where event_type = 'purchase' group by all) select v.event_id, p.last_value from (select * from events where event_type = 'view') v asof left join p on v.user_id = p.user_id and v.ts >= p.ts",
    "range_join": "select n_nationkey, count(*) n from customer, nation where c_acctbal >= n_nationkey * 400.0 - 1000 and c_acctbal < n_nationkey * 400.0 - 400 group by 1",
    "order_cube": "select o_orderstatus, o_orderpriority, count(*) n, round(sum(o_totalprice), 2) total, grouping(o_orderstatus, o_orderpriority) gid from orders group by cube (o_orderstatus, o_orderpriority)",
    "running_frame": "select o_orderkey, round(avg(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 4) mean3, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) before from orders",
    "revenue_by_nation": "select r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, count(distinct o_orderkey) orders from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all",
}

"""Queries on time series and side files, and relational extensions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import series as S
from ..sources import tables as T
from ..streaming import live
from .registry import query, table


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))


_T = "epoch_us(ts) / 1000000.0::DOUBLE"


@query("SELECT event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n % 5 = 0")
def sample_every_x(spark, sf):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return S.every(table(spark, sf, "events").withColumn("n", n), "n", 5).select("event_id", "value")


@query(
    f"""WITH RECURSIVE f AS (SELECT user_id, CASE WHEN event_id % 10 = 0 THEN floor({_T} / 86400) * 86400 ELSE {_T} END AS t FROM events),
e AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n FROM f),
s AS (SELECT user_id, n, t AS last, 1 AS frames FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, CASE WHEN (e.t - s.last) * 0.0001::DOUBLE >= 1 THEN e.t ELSE s.last END, s.frames + CASE WHEN (e.t - s.last) * 0.0001::DOUBLE >= 1 OR e.t = s.last THEN 1 ELSE 0 END
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, CAST(max(frames) AS BIGINT) AS frames FROM s GROUP BY user_id"""
)
def frame_sampler(spark, sf):
    # Every tenth event is told to the hour, so that times repeat.
    e = _events(spark, sf).withColumn("t", F.when(F.col("event_id") % 10 == 0, F.floor(F.col("t") / 86400) * 86400.0).otherwise(F.col("t")))
    return S.frame_sampler(e, "user_id", "t", 0.0001).groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"))


@query("SELECT event_id, lag(value) OVER w AS value_prev, first_value(value) OVER w AS value_begin FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_front_back(spark, sf):
    return S.previous(table(spark, sf, "events"), "value", ["user_id"], ["ts", "event_id"]).select("event_id", "value_prev", "value_begin")


@query("SELECT event_id FROM events WHERE epoch_us(ts) BETWEEN (SELECT min(epoch_us(ts)) FROM events) + 3600000000 AND (SELECT min(epoch_us(ts)) FROM events) + 360000000000")
def time_range(spark, sf):
    e = _events(spark, sf)
    start = e.agg(F.min("t")).first()[0]
    return S.between(e, "t", start + 3600, start + 360000).select("event_id")


# Days from the first event's to the last one's, in seconds from the start of the first.
_GRID = f"""WITH lim AS (SELECT floor(min({_T}) / 86400) * 86400 AS base, max({_T}) AS last FROM events),
e AS (SELECT user_id, {_T} - base AS t, value FROM events, lim),
days AS (SELECT CAST(unnest(range(0, CAST(floor((last - base) / 86400) AS BIGINT) + 1)) AS DOUBLE) * 86400 AS t FROM lim),
g AS (SELECT user_id, t FROM (SELECT DISTINCT user_id FROM events), days),
lo AS (SELECT g.user_id, g.t, e.t AS t0, e.value AS v0 FROM g ASOF LEFT JOIN e ON g.user_id = e.user_id AND g.t >= e.t),
hi AS (SELECT g.user_id, g.t, e.t AS t1, e.value AS v1 FROM g ASOF LEFT JOIN e ON g.user_id = e.user_id AND g.t <= e.t)"""


def _resampled(spark, sf, linear):
    e = _events(spark, sf)
    first, last = e.agg(F.min("t"), F.max("t")).first()
    base = (first or 0.0) // 86400 * 86400
    e = e.withColumn("t", F.col("t") - base)
    out = S.resample(e, "user_id", "t", "value", 0.0, ((last or 0.0) - base) // 86400 * 86400, 86400.0, linear)
    return out.select("user_id", "t", F.round("value", 6).alias("value"))


@query(f"{_GRID} SELECT user_id, t, round(v0, 6) AS value FROM lo", "ours")
def resample_locf(spark, sf):
    return _resampled(spark, sf, False)


@query(f"{_GRID} SELECT user_id, t, round(CASE WHEN t1 = t0 THEN v0 ELSE v0 + (t - t0) / (t1 - t0) * (v1 - v0) END, 6) AS value FROM lo JOIN hi USING (user_id, t)", "ours")
def resample_linear(spark, sf):
    return _resampled(spark, sf, True)


@query("SELECT user_id, CAST(sum(CASE WHEN p IS DISTINCT FROM event_type THEN 1 ELSE 0 END) AS BIGINT) AS runs FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) GROUP BY user_id")
def without_repeats(spark, sf):
    found = S.changes(table(spark, sf, "events").select("user_id", "ts", "event_type"), ["user_id"], "ts", "event_type")
    return found.groupBy("user_id").agg(F.sum(F.col("new").cast("long")).alias("runs"))


@query("SELECT l_returnflag, CAST(l_linenumber AS DOUBLE) AS number, CAST(count(*) AS DOUBLE) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_returnflag, l_linenumber")
def perf_table_parse(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    line = F.concat_ws("\t", F.col("l_linenumber").cast("string"), F.col("n").cast("string"), F.col("q").cast("string"))
    texts = sums.groupBy("l_returnflag").agg(F.concat(F.lit("# number\tlines\tquantity\n"), F.array_join(F.collect_list(line), "\n")).alias("text"))
    return T.performance_table(texts, ["number", "lines", "quantity"]).select("l_returnflag", "number", "lines", "quantity")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", "extension")
def event_window_tumbling(spark, sf):
    out = live.windows(table(spark, sf, "events"), "ts", "1 hour", by=["event_type"])
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "extension")
def x_rollup(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "extension")
def x_cube(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)", "extension")
def x_semi(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", "extension")
def x_anti(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT a.event_id, b.value AS last_purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts >= b.ts", "extension")
def x_asof(spark, sf):
    e = table(spark, sf, "events")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_purchase"))
    return S.as_of(e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "last_purchase").select("event_id", "last_purchase")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25", "extension")
def x_topk(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25)


@query("SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS INTEGER) AS place, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS quarter FROM customer", "extension")
def x_rank(spark, sf):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))
    return table(spark, sf, "customer").select("c_custkey", F.rank().over(w).alias("place"), F.ntile(4).over(w.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("quarter"))


@query("SELECT p_size AS v FROM part EXCEPT SELECT c_nationkey FROM customer", "extension")
def x_except(spark, sf):
    return table(spark, sf, "part").select(F.col("p_size").alias("v")).subtract(table(spark, sf, "customer").select("c_nationkey"))


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""", "extension"
)
def x_pricing_summary(spark, sf):
    rows = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))

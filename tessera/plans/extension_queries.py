"""Relational extensions: interval joins, more aggregates and frames, table functions, and text, map, date and JSON functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import aggregates, selection
from .registry import query, table


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """Points with all intervals [start, end) that hold them, through buckets of ``width``: an equi-join, in which an interval stands in each bucket that it meets.

    A bucket with more than its share of the points is dealt out over several places, each with a copy of its intervals.
    The number of places is fixed, as few bytes can make many pairs and Spark would join them in one task.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = points.groupBy(bucket(at).alias("_bucket")).count()
    share = -(-(counts.agg(F.sum("count")).first()[0] or 1) // (4 * n))
    hot = counts.where(F.col("count") > share).select("_bucket", F.ceil(F.col("count") / share).alias("_places"))  # 4 n rows at most
    placed = lambda rows: rows.join(F.broadcast(hot), "_bucket", "left").withColumn("_places", F.coalesce("_places", F.lit(1)))
    cut = intervals.where(F.col(start) < F.col(end)).withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    cut = placed(cut).withColumn("_place", F.explode(F.sequence(F.lit(0), F.col("_places") - 1))).drop("_places")
    dealt = placed(points.withColumn("_bucket", bucket(at))).withColumn("_place", F.monotonically_increasing_id() % F.col("_places")).drop("_places")
    deal = lambda rows: rows.repartition(n, "_bucket", "_place")
    return deal(dealt).join(deal(cut).hint("shuffle_hash"), ["_bucket", "_place"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket", "_place")


@query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice >= s_acctbal AND p_retailprice < s_acctbal + 50", "extension")
def x_interval_join(spark, sf):
    spans = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 50).alias("high"))
    return interval_join(table(spark, sf, "part").select("p_partkey", "p_retailprice"), spans, "p_retailprice", "low", "high", 50.0).select("p_partkey", "s_suppkey")


@query(
    "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS middle, quantile_cont(l_extendedprice, 0.9) AS high, count(DISTINCT l_suppkey) AS suppliers, true AS approximate_fits FROM lineitem GROUP BY l_returnflag",
    "extension",
)
def x_percentiles(spark, sf):
    """Exact ones, and approximate ones that lie within their stated errors of them."""
    rows = table(spark, sf, "lineitem")
    exact = selection.quantiles(rows, ["l_returnflag"], "l_extendedprice", [0.5, 0.9])
    # Apart from the distinct count, beside which a task would hold sketches of each supplier.
    sketches = rows.groupBy("l_returnflag").agg(F.approx_count_distinct("l_suppkey", 0.02).alias("about"), F.percentile_approx("l_extendedprice", 0.5, 1000).alias("near"))
    distinct = rows.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"))
    out = distinct.join(sketches, "l_returnflag").join(exact, "l_returnflag").withColumns({"middle": F.col("quantiles")[0], "high": F.col("quantiles")[1]})
    fits = (F.abs(F.col("about") - F.col("suppliers")) <= 0.1 * F.col("suppliers")) & (F.abs(F.col("near") - F.col("middle")) <= 0.02 * F.col("middle"))
    return out.select("l_returnflag", "middle", "high", "suppliers", fits.alias("approximate_fits"))


@query(
    """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS around,
 round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW), 4) AS of_a_day,
 nth_value(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM events""",
    "extension",
)
def x_frames(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    day = Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    return e.select(
        "event_id", F.round(F.sum("value").over(w.rowsBetween(-2, 1)), 4).alias("around"), F.round(F.sum("value").over(day), 4).alias("of_a_day"),
        F.nth_value("value", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("second"),
    )


@query("SELECT o_orderstatus, round(exp(avg(ln(o_totalprice))), 4) AS geometric_mean, bit_or(o_custkey) AS any_bit, bit_and(o_custkey) AS all_bits FROM orders GROUP BY o_orderstatus", "extension")
def x_reductions(spark, sf):
    """Reductions that partial results can be merged with: a mean of one's own, and bits."""
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.round(F.exp(F.avg(F.ln("o_totalprice"))), 4).alias("geometric_mean"), F.bit_or("o_custkey").alias("any_bit"), F.bit_and("o_custkey").alias("all_bits")
    )


@query(
    """WITH h AS (SELECT DISTINCT l_returnflag, CAST('0x' || substr(md5(CAST(l_partkey AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM lineitem),
k AS (SELECT l_returnflag, h, row_number() OVER (PARTITION BY l_returnflag ORDER BY h) AS n, count(*) OVER (PARTITION BY l_returnflag) AS m FROM h),
d AS (SELECT l_returnflag, CASE WHEN max(m) < 256 THEN max(m) ELSE 255 / (max(h) FILTER (n = 256) / CAST(1::BIGINT << 60 AS DOUBLE)) END AS parts FROM k GROUP BY l_returnflag),
s AS (SELECT l_returnflag, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS price FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, round(price, 2) AS price, round(parts, 6) AS parts FROM s JOIN d USING (l_returnflag)""",
    "extension",
)
def x_user_aggregates(spark, sf):
    """Aggregates by name: an exact sum of doubles, and a mergeable sketch of distinct parts."""
    rows = table(spark, sf, "lineitem").withColumn("h", F.conv(F.substring(F.md5(F.col("l_partkey").cast("string")), 1, 15), 16, 10).cast("long"))
    uses = {"price": aggregates.Use("exact_sum", ("l_extendedprice",)), "parts": aggregates.Use("distinct_sketch", ("h",))}
    found = aggregates.aggregate(rows, ["l_returnflag"], uses)
    return found.select("l_returnflag", F.round("price", 2).alias("price"), F.round("parts", 6).alias("parts"))


@F.udtf(returnType="place int, word string")
class Words:
    """The words of a text with their places."""

    def eval(self, text: str):
        yield from enumerate((text or "").split())


@query("SELECT p_partkey, CAST(i - 1 AS INTEGER) AS place, w[i] AS word FROM (SELECT p_partkey, string_split(p_type, ' ') AS w, unnest(range(1, len(string_split(p_type, ' ')) + 1)) AS i FROM part) WHERE w[i] <> ''", "extension")
def x_table_function(spark, sf):
    spark.udtf.register("tessera_words", Words)
    return spark.sql("SELECT p_partkey, w.place, w.word FROM {part}, LATERAL tessera_words(p_type) w", part=table(spark, sf, "part"))


@query(
    """SELECT event_id, upper(event_type) AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, date_trunc('hour', ts) AS hour,
 event_type LIKE '%c%' AS has_c, regexp_replace(event_type, '[aeiou]', '', 'g') AS consonants, lpad(CAST(user_id AS VARCHAR), 6, '0') AS padded FROM events""",
    "extension",
)
def x_text_functions(spark, sf):
    parsed = F.from_json("props", "map<string,int>")
    return table(spark, sf, "events").select(
        "event_id", F.upper("event_type").alias("kind"), parsed["k"].alias("k"), F.year("ts").alias("year"), F.month("ts").alias("month"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
        F.col("event_type").like("%c%").alias("has_c"), F.regexp_replace("event_type", "[aeiou]", "").alias("consonants"), F.lpad(F.col("user_id").cast("string"), 6, "0").alias("padded"),
    )

"""Queries on vectors, ids and scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import ids
from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import pairs as P
from .graph import KINDS, Graph, lookup_kind, register
from .registry import BODY, bodies, query, table
from .stages import StagedGraph

_E = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


def _doubles(name="embedding"):
    return F.transform(name, lambda x: x.cast("double"))


@query(f"SELECT vec_id, round(list_inner_product({_E}, list_reverse({_E})), 6) AS dot FROM embeddings")
def vec_dot(spark, sf):
    e = _doubles()
    return table(spark, sf, "embeddings").select("vec_id", F.round(V.dot(e, F.reverse(e)), 6).alias("dot"))


@query(f"SELECT vec_id, round(sqrt(list_inner_product({_E}, {_E})), 6) AS norm FROM embeddings")
def vec_norm(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(V.norm(_doubles()), 6).alias("norm"))


@query("SELECT vec_id, CAST(embedding[CAST(vec_id % 64 AS INTEGER) + 1] AS DOUBLE) AS component FROM embeddings")
def vec_component(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", V.component(F.col("embedding"), (F.col("vec_id") % 64).cast("int")).cast("double").alias("component"))


# A turn by 90 degrees about z, then a shift: (x, y, z) -> (1 - y, 2 + x, 3 + z); the quaternion has rational parts up to sqrt(1/2).
@query(f"WITH {BODY} SELECT id, round(1 - y, 6) AS tx, round(2 + x, 6) AS ty, round(3 + z, 6) AS tz FROM body")
def vec_transform3d(spark, sf):
    h = math.sqrt(0.5)
    out = V.transform(V.vec(0, 0, h, h), V.vec(1, 2, 3), V.vec(F.col("x"), F.col("y"), F.col("z")))
    return bodies(spark, sf).withColumn("t", out).select("id", *(F.round(F.col("t")[i], 6).alias(f"t{c}") for i, c in enumerate("xyz")))


@query(
    "SELECT c_custkey, coalesce(n_name, 'UNKNOWN') AS n_name FROM customer "
    "LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON c_nationkey = n_nationkey"
)
def lookup_default(spark, sf):
    nations = table(spark, sf, "nation").where("n_nationkey % 3 <> 0").withColumnRenamed("n_nationkey", "c_nationkey")
    return P.lookup(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), nations, "c_nationkey", "n_name", "UNKNOWN").select("c_custkey", "n_name")


@query(
    "SELECT event_id, user_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS held FROM events"
)
def lookup_held(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("held"))
    return P.carried_forward(rows, "held", ["user_id"], "event_id")


@query(f"SELECT label, count(*) AS n, round(avg(norm), 6) AS mean_norm, round(max(norm), 6) AS max_norm FROM (SELECT label, sqrt(list_inner_product({_E}, {_E})) AS norm FROM embeddings) GROUP BY label")
def graph_norm_by_label(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", _doubles().alias("embedding"))
    graph = Graph({"embedding": "vector"}).add("norm", "norm").add("out", "line")
    graph.link("source", "embedding", "norm", "value").link("norm", "result", "out", "value")
    norms = graph.run(rows, keep=["label"])
    return norms.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("out"), 6).alias("mean_norm"), F.round(F.max("out"), 6).alias("max_norm"))


@query(
    f"WITH {BODY} SELECT id, round(2 + x * x + y * y + z * z, 6) AS total, CASE id % 4 WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'other' END AS name FROM body WHERE mass <= 40"
)
def graph_full(spark, sf):
    if "names" not in KINDS:
        register("names", lookup_kind({1: "one", 2: "two"}, "other"))
    rows = bodies(spark, sf).select("id", V.vec(F.col("x"), F.col("y"), F.col("z")).alias("pos"), (F.col("id") % 4).alias("k"), (F.col("mass") > 40).alias("heavy"))
    g = Graph({"pos": "vector", "k": "long", "heavy": "bool"})
    g.add("one", "constant.double", value=1.0).add("dot", "dot").add("sum", "sum_plus_one").add("name", "names").add("stop", "stop")
    g.push("source", "pos", [("dot", "a"), ("dot", "b")]).link("dot", "result", "sum", "a").link("one", "value", "sum", "b")
    g.link("source", "k", "name", "key").link("source", "heavy", "stop", "enable")
    out = g.run(rows, ["id"], {"total": ("sum", "x"), "name": ("name", "value")})
    return out.select("id", F.round("total", 6).alias("total"), "name")


@query(
    """WITH o AS (SELECT o_orderkey, o_totalprice + 1 AS head FROM orders WHERE o_custkey % 10 <> 0),
l AS (SELECT o_orderkey, l_linenumber, l_extendedprice, head FROM lineitem JOIN o ON l_orderkey = o_orderkey)
SELECT o_orderkey, 0 AS stage, 0::BIGINT AS line, round(head, 3) AS value FROM o
UNION ALL SELECT o_orderkey, 1, CAST(l_linenumber AS BIGINT), round(l_extendedprice + head + 1, 3) FROM l
UNION ALL SELECT o_orderkey, 2, 0, round(coalesce(s, 0) + head + 1 + coalesce(n, 0), 3) FROM o LEFT JOIN (SELECT o_orderkey, sum(l_extendedprice) AS s, count(*) AS n FROM l GROUP BY o_orderkey) USING (o_orderkey)"""
)
def graph_stages(spark, sf):
    """A group of writers with a member before, for and after the bodies: orders are the states, their lines the bodies; some states stop."""
    states = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 10 == 0).alias("idle"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("line"), "l_extendedprice")
    g = StagedGraph("o_orderkey", {"l_extendedprice": "double"}, {"o_totalprice": "double", "idle": "bool"})
    g.add_group("writer", {"init": ("frame_init", "line", {}), "add": ("body", "line", {}), "final": ("frame_final", "line", {})})
    g.add("head", "sum_plus_one", stage="frame_init").add("idle", "stop", stage="frame_init").link("state", "o_totalprice", "head", "a").link("state", "idle", "idle", "enable")
    g.add("cost", "sum_plus_one").link("source", "l_extendedprice", "cost", "a").link("head", "x", "cost", "b")
    g.add("sum", "reduce.sum", stage="frame_final").add("n", "reduce.count", stage="frame_final").push("source", "l_extendedprice", [("sum", "value"), ("n", "value")])
    g.add("count", "number", stage="frame_final").link("n", "result", "count", "value")
    g.add("rest", "sum_plus_one", stage="frame_final").link("sum", "result", "rest", "a").link("head", "x", "rest", "b")
    g.add("tail", "sum_plus_one", stage="frame_final").link("rest", "x", "tail", "a").link("count", "result", "tail", "b")
    g.link("head", "x", "writer.init", "value").link("cost", "x", "writer.add", "value").link("tail", "x", "writer.final", "value")
    f = g.run_frames(states, lines, ["line"])
    part = lambda rows, stage, name, line, less=0.0: rows.select("o_orderkey", F.lit(stage).alias("stage"), line.cast("long").alias("line"), F.round(F.col(f"`writer.{name}`") - less, 3).alias("value"))
    none = F.lit(0)
    return part(f.frame_init, 0, "init", none).unionByName(part(f.body, 1, "add", F.col("line"))).unionByName(part(f.frame_final, 2, "final", none, 1.0))


@query(f"WITH {BODY} SELECT id, (group_nr << 32) | body_nr AS packed, group_nr, body_nr FROM body")
def id_pack_unpack(spark, sf):
    packed = bodies(spark, sf).select("id", ids.pack(F.col("group_nr"), F.col("body_nr")).alias("packed"))
    return packed.select("id", "packed", ids.group_of(F.col("packed")).alias("group_nr"), ids.body_of(F.col("packed")).alias("body_nr"))


@query(f"WITH {BODY} SELECT id, '(' || group_nr || ',' || body_nr || ')' AS name FROM body")
def id_text(spark, sf):
    return bodies(spark, sf).select("id", ids.text_of(ids.pack(F.col("group_nr"), F.col("body_nr"))).alias("name"))


_TAU = repr(2 * math.pi)


@query(f"SELECT event_id, round(value - floor(value / {_TAU}::DOUBLE + 0.5::DOUBLE) * {_TAU}::DOUBLE, 6) AS angle FROM events")
def angle_wrap_pi(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(S.wrap_pi(F.col("value")), 6).alias("angle"))


@query(f"SELECT event_id, round(value - floor(value / {_TAU}::DOUBLE) * {_TAU}::DOUBLE, 6) AS angle FROM events")
def angle_wrap_2pi(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(S.wrap_2pi(F.col("value")), 6).alias("angle"))


@query(f"SELECT event_id, round((user_id - value) - floor((user_id - value) / {_TAU}::DOUBLE + 0.5::DOUBLE) * {_TAU}::DOUBLE, 6) AS angle FROM events")
def angle_relative(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(S.relative_angle(F.col("value"), F.col("user_id").cast("double")), 6).alias("angle"))


@query("SELECT l_orderkey, l_linenumber, CAST(gcd(l_partkey, l_suppkey) AS BIGINT) AS g FROM lineitem")
def gcd2(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.gcd(F.col("l_partkey"), F.col("l_suppkey")).alias("g"))


@query("SELECT o_orderkey, CAST(gcd(gcd(o_orderkey, o_custkey), 36) AS BIGINT) AS g FROM orders")
def gcd3(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.gcd(S.gcd(F.col("o_orderkey"), F.col("o_custkey")), F.lit(36)).alias("g"))


@query(
    """WITH s AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) / CAST(50 AS DOUBLE) AS v FROM part)
SELECT id, round(CASE WHEN v < 0.5 THEN 0 WHEN v < 0.75 THEN (v - 0.5) * 4 ELSE 1 END, 6)::DOUBLE AS red,
       round(CASE WHEN v < 0 THEN 0 WHEN v < 0.25 THEN v * 4 WHEN v < 0.75 THEN 1 WHEN v < 1 THEN 1 - (v - 0.75) * 4 ELSE 0 END, 6)::DOUBLE AS green,
       round(CASE WHEN v < 0.25 THEN 1 WHEN v < 0.5 THEN 1 - (v - 0.25) * 4 ELSE 0 END, 6)::DOUBLE AS blue FROM s"""
)
def color_gradient(spark, sf):
    c = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.color(F.col("p_size") / F.lit(50.0)).alias("c"))
    return c.select("id", *(F.abs(F.round(F.col(f"c.{k}"), 6)).alias(k) for k in ("red", "green", "blue")))


def _xyz():
    return V.vec(F.col("x"), F.col("y"), F.col("z"))


@query(f"WITH {BODY} SELECT id, concat_ws(' ', CAST(-z AS BIGINT), CAST(y AS BIGINT), CAST(z AS BIGINT), CAST(-x AS BIGINT), CAST(-y AS BIGINT), CAST(x AS BIGINT)) AS off_diagonal FROM body")
def skew_matrix(spark, sf):
    m = V.skew(_xyz())
    at = [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
    return bodies(spark, sf).select("id", F.concat_ws(" ", *(m[i][j].cast("long").cast("string") for i, j in at)).alias("off_diagonal"))


@query(
    f"""WITH {BODY}, e AS (SELECT id, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(x*x + y*y + z*z) AS n FROM body) WHERE n > 0),
s AS (SELECT *, CASE WHEN abs(x) > abs(z) THEN -z / sqrt(x*x + z*z) ELSE 0 END AS sx,
  CASE WHEN abs(x) > abs(z) THEN 0 ELSE z / sqrt(y*y + z*z) END AS sy,
  CASE WHEN abs(x) > abs(z) THEN x / sqrt(x*x + z*z) ELSE -y / sqrt(y*y + z*z) END AS sz FROM e)
SELECT id, round(x, 6) AS e1x, round(sx + 0.0, 6) + 0.0 AS e2x, round(sy, 6) + 0.0 AS e2y, round(y * sz - z * sy, 6) + 0.0 AS e3x, true AS orthogonal FROM s"""
)
def basis_from_vector(spark, sf):
    b = bodies(spark, sf).withColumn("e", V.basis(_xyz())).where("e is not null")
    at = lambda i, j: F.round(F.col("e")[i][j], 6) + 0.0
    return b.select("id", at(0, 0).alias("e1x"), at(1, 0).alias("e2x"), at(1, 1).alias("e2y"), at(2, 0).alias("e3x"), V.is_orthogonal(F.col("e")).alias("orthogonal"))


@query(f"WITH {BODY} SELECT id, 2 * (x * 1 + y * 2 + z * 3) + mass * 1 + r * 0 AS checksum FROM body")
def sym_matrix(spark, sf):
    m = V.symmetric(V.vec(F.col("mass"), F.col("x"), F.col("y") * 2, F.lit(0.0), F.col("z") * 3, F.lit(0.0)))
    return bodies(spark, sf).select("id", F.aggregate(F.flatten(m), F.lit(0.0), lambda s, v: s + v).alias("checksum"))


@query(
    f"""WITH {BODY} SELECT id, CASE WHEN id % 2 = 0 THEN 0 ELSE -(y * (3 * mass) * z - z * (2 * mass) * y) END + 0.0::DOUBLE AS hx FROM body"""
)
def gyro_term(spark, sf):
    kind = F.when(F.col("id") % 2 == 0, "sphere").otherwise("box")
    inertia = V.vec(F.col("mass"), F.col("mass") * 2, F.col("mass") * 3)
    return bodies(spark, sf).select("id", (S.gyro_term(kind, V.vec(0, 0, 0), inertia, _xyz())[0] + 0.0).alias("hx"))


@query(f"WITH {BODY} SELECT id, round(1 / mass, 9) AS inv_mass, round(1 / (2 * mass), 9) AS inv_inertia FROM body")
def mass_inverse(spark, sf):
    inertia = V.vec(F.col("mass") * 2, F.col("mass") * 2, F.col("mass") * 2)
    d = S.inverse_diagonal(S.mass_diagonal(F.col("mass"), inertia))
    return bodies(spark, sf).select("id", F.round(d[0], 9).alias("inv_mass"), F.round(d[3], 9).alias("inv_inertia"))


@query(f"WITH {BODY}, c AS (SELECT unnest(range(8)) AS i) SELECT id, CAST(i AS INTEGER) AS corner, (CASE WHEN i & 1 = 1 THEN -0.5 ELSE 0.5 END)::DOUBLE * x + 0.0 AS cx, (CASE WHEN i & 2 = 2 THEN -0.5 ELSE 0.5 END)::DOUBLE * y + 0.0 AS cy, (CASE WHEN i & 4 = 4 THEN -0.5 ELSE 0.5 END)::DOUBLE * z + 0.0 AS cz FROM body, c")
def box_corners(spark, sf):
    rows = bodies(spark, sf).select("id", F.posexplode(V.box_corners(_xyz())).alias("corner", "c"))
    return rows.select("id", "corner", *((F.col("c")[i] + 0.0).alias(f"c{k}") for i, k in enumerate("xyz")))


@query(f"WITH {BODY} SELECT id, round(x + 3.0 / 5 * r, 6) AS px, round(y + 4.0 / 5 * r, 6) AS py, z AS pz FROM body")
def ray_point(spark, sf):
    p = V.ray_point(_xyz(), V.vec(3, 4, 0), F.col("r"))
    return bodies(spark, sf).withColumn("p", p).select("id", F.round(F.col("p")[0], 6).alias("px"), F.round(F.col("p")[1], 6).alias("py"), F.col("p")[2].alias("pz"))


# Lists made from part keys: every seventh has a bad token.
_LIST = "concat_ws(' ', p_partkey, p_size, CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE '4.5' END)"


@query(f"SELECT p_partkey, p_partkey % 7 <> 0 AS ok, CAST(CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 3 END AS INTEGER) AS n, CAST(p_partkey + p_size AS DOUBLE) + CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 4.5 END AS total FROM part")
def parse_vector(spark, sf):
    p = table(spark, sf, "part").withColumn("p", S.parse_numbers(F.expr(_LIST), 3))
    return p.select("p_partkey", "p.ok", F.size("p.values").alias("n"), F.aggregate("p.values", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("SELECT p_partkey, p_partkey % 5 <> 0 AS ok, (p_partkey << 32) | p_size AS first FROM part")
def parse_pairs(spark, sf):
    text = F.expr("concat(p_partkey, ',', p_size, CASE WHEN p_partkey % 5 = 0 THEN ' 1,2,4' ELSE ' 0,7' END)")
    return table(spark, sf, "part").withColumn("p", S.parse_pairs(text)).select("p_partkey", "p.ok", F.col("p.values")[0].alias("first"))


@query("SELECT p_partkey, p_partkey % 4 <> 0 AS ok, CAST(CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 4 END AS INTEGER) AS n, p_size % 2 = 1 AS first FROM part")
def parse_bools(spark, sf):
    text = F.expr("concat(p_size % 2, ' true ', CASE WHEN p_partkey % 4 = 0 THEN 'yes' ELSE 'false' END, ' 1 ')")
    return table(spark, sf, "part").withColumn("p", S.parse_bools(text)).select("p_partkey", "p.ok", F.size("p.values").alias("n"), F.col("p.values")[0].alias("first"))


@query("SELECT p_partkey, CAST(len(list_distinct([p_size % 3, p_size % 5, p_partkey % 3])) AS INTEGER) AS n, false AS ok FROM part")
def distinct_parse(spark, sf):
    p = S.parse_int_set(F.expr("concat_ws(' ', p_size % 3, p_size % 5, p_partkey % 3, '8.5', '9')"))
    return table(spark, sf, "part").withColumn("p", p).select("p_partkey", F.size("p.values").alias("n"), "p.ok")


# Texts that fit some domains and miss others by one character.
_TEXTS = """SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN '1 2 3' WHEN 1 THEN ' 1.5 -2e3 +3 ' WHEN 2 THEN '.5 1 2' WHEN 3 THEN '1. 2 3' WHEN 4 THEN '1E5 2 3' WHEN 5 THEN '' WHEN 6 THEN '1e-1'
 WHEN 7 THEN '+' WHEN 8 THEN '0' WHEN 9 THEN '1,2 3,4' WHEN 10 THEN concat(p_size, '') ELSE concat('-', p_size) END AS t FROM part"""
_REAL = r"[+-]?\d+(\.\d+)?(e[+-]?\d+)?"


@query(
    f"""SELECT p_partkey, regexp_full_match(t, '[ \\t\\r\\n]*{_REAL}([ \\t\\r\\n]+{_REAL}){{2}}[ \\t\\r\\n]*') AS is_vector3, regexp_full_match(t, '\\d+,\\d+( \\d+,\\d+)*') AS is_pair_list,
 p_partkey % 12 IN (6, 10) AS is_positive, p_partkey % 12 IN (6, 8) OR (p_partkey % 12 = 10 AND p_size <= 1) AS is_share, p_partkey % 12 IN (8, 10) AS is_count FROM ({_TEXTS})
 JOIN (SELECT p_partkey, p_size FROM part) USING (p_partkey)"""
)
def xsd_domain_check(spark, sf):
    rows = spark.sql(_TEXTS.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))
    is_in = lambda domain: S.in_domain(F.col("t"), domain)
    return rows.select(
        "p_partkey", is_in("Vector3").alias("is_vector3"), is_in("commaSeperatedPairsOfUnsignedInts").alias("is_pair_list"), is_in("positiveDouble").alias("is_positive"), is_in("zeroToOneDouble").alias("is_share"), is_in("nonNegativeInt").alias("is_count")
    )


@query("SELECT event_id, CAST(CASE WHEN user_id % 5 = 0 THEN 40 ELSE least(floor(event_id / (user_id % 5)) + 1, 40) END AS BIGINT) AS ticks FROM events")
def progress_index(spark, sf):
    return table(spark, sf, "events").select("event_id", S.progress(F.col("event_id"), F.col("user_id") % 5, 40).alias("ticks"))


@query("SELECT p_partkey, concat_ws(' ', substr(b, 25, 8), substr(b, 17, 8), substr(b, 9, 8), substr(b, 1, 8)) AS bits FROM (SELECT p_partkey, lpad(bin(p_partkey), 32, '0') AS b FROM part)")
def bit_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.bits(F.col("p_partkey")).alias("bits"))


@query("SELECT event_id, CAST(greatest(1, floor(1.0::DOUBLE / ((1 + user_id % 50) * 0.001::DOUBLE))) AS BIGINT) AS x FROM events")
def steps_from_rate(spark, sf):
    rate = (F.lit(1) + F.col("user_id") % 50).cast("double")
    return table(spark, sf, "events").select("event_id", S.record_every(rate, F.lit(0.001)).alias("x"))


_E3 = "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings"


def _e3(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))


@query(f"SELECT vec_id, round(x * s, 6) + 0.0 AS px, round(y * s, 6) + 0.0 AS py FROM (SELECT *, CASE WHEN sqrt(x*x + y*y) > 0.1 THEN 0.1::DOUBLE / sqrt(x*x + y*y) ELSE 1 END AS s FROM ({_E3}))", "ours")
def prox_disk(spark, sf):
    p = _e3(spark, sf).withColumn("p", S.prox_disk(F.col("x"), F.col("y"), F.lit(0.1)))
    return p.select("vec_id", (F.round(F.col("p")[0], 6) + 0.0).alias("px"), (F.round(F.col("p")[1], 6) + 0.0).alias("py"))


@query(f"SELECT vec_id, greatest(x, 0.0::DOUBLE) + 0.0 AS px FROM ({_E3})", "ours")
def prox_rplus(spark, sf):
    return _e3(spark, sf).select("vec_id", (S.prox_half_line(F.col("x")) + 0.0).alias("px"))


@query(f"SELECT vec_id, greatest(-0.1::DOUBLE, least(0.1::DOUBLE, x)) AS px, greatest(-0.1::DOUBLE, least(0.1::DOUBLE, z)) AS pz FROM ({_E3})", "ours")
def prox_box(spark, sf):
    p = _e3(spark, sf).withColumn("p", S.prox_box(V.vec(F.col("x"), F.col("y"), F.col("z")), -0.1, 0.1))
    return p.select("vec_id", F.col("p")[0].alias("px"), F.col("p")[2].alias("pz"))


@query(
    f"""SELECT vec_id, round(CASE WHEN t <= 0.8 * z THEN z WHEN 0.8 * t <= -z THEN 0 ELSE (z + 0.8 * t) / 1.64 END, 6) + 0.0::DOUBLE AS pn
FROM (SELECT *, sqrt(x*x + y*y) AS t FROM ({_E3}))""", "ours"
)
def prox_cone(spark, sf):
    p = S.prox_cone(F.col("z"), F.col("x"), F.col("y"), F.lit(0.8))
    return _e3(spark, sf).select("vec_id", (F.round(p[0], 6) + 0.0).alias("pn"))


@query("SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf):
    s = table(spark, sf, "supplier").select("s_nationkey")
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey")).intersect(s)


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query(f"WITH {BODY} SELECT id, 'Sphere ' || r || ' -' || r || ' ' || r || '  360' || chr(10) AS line FROM body")
def sphere_line(spark, sf):
    return bodies(spark, sf).select("id", S.sphere_text(F.col("r")).alias("line"))


@query(f"WITH {BODY} SELECT id, round(0.4::DOUBLE * mass * r * r, 9) AS inertia FROM body", "ours")
def sphere_inertia(spark, sf):
    i = S.inertia_of(F.lit("sphere"), F.col("mass"), F.col("r"), V.vec(0, 0, 0))
    return bodies(spark, sf).select("id", F.round(i[0], 9).alias("inertia"))


@query(f"WITH {BODY} SELECT id, round(CASE WHEN abs(x) > 20 THEN x / 2.54::DOUBLE * 72 ELSE 0 END, 6) AS points, greatest(0, least(20, x))::DOUBLE AS clamped FROM body")
def unit_and_clamp(spark, sf):
    return bodies(spark, sf).select("id", F.round(F.when(F.abs("x") > 20, S.centimetres_to_points(F.col("x"))).otherwise(0.0), 6).alias("points"), V.clamp(F.col("x"), F.lit(0.0), F.lit(20.0)).alias("clamped"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END::BIGINT AS code, ' Postprocess: ' || o_orderkey || ' : a:\"' || o_orderstatus || '\", b:\"x\"' AS line FROM orders")
def enum_and_task_text(spark, sf):
    options = F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.col("o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", S.enum_code(F.col("o_orderstatus"), ["F", "O", "P"]).alias("code"), S.task_text(F.col("o_orderkey").cast("string"), options).alias("line"))


@query("SELECT count(*) AS n, 0::BIGINT AS outside, true AS uniform_fits, true AS normal_fits, true AS truncated_fits FROM customer")
def random_values(spark, sf):
    """Shares below a few values lie within five standard deviations of the distributions' own."""
    from statistics import NormalDist

    n = table(spark, sf, "customer").select("c_custkey", S.uniform(-1.0, 1.0, 7).alias("u"), S.normal(1.0, 2.0, 5).alias("g"), S.truncated_normal(0.0, 1.0, -0.5, 2.0, 11).alias("v"))
    cdf, bottom = NormalDist().cdf, NormalDist().cdf(-0.5)
    mass = cdf(2.0) - bottom
    expected = {"u": {x: (x + 1) / 2 for x in (-0.5, 0.0, 0.7)}, "g": {x: cdf((x - 1) / 2) for x in (-2.0, 1.0, 3.0)}, "v": {x: (cdf(x) - bottom) / mass for x in (-0.2, 0.3, 1.2)}}
    fits = lambda c: F.greatest(*(F.abs(F.avg((F.col(c) < x).cast("double")) - p) for x, p in expected[c].items())) <= 2.5 / F.sqrt(F.count(F.lit(1)))
    outside = F.count_if((F.abs("u") > 1) | (F.col("v") < -0.5) | (F.col("v") > 2.0))
    return n.agg(F.count(F.lit(1)).alias("n"), outside.alias("outside"), fits("u").alias("uniform_fits"), fits("g").alias("normal_fits"), fits("v").alias("truncated_fits"))

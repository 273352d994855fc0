"""Queries that write and read back: the state store, side files, sinks and streams; and single operators on bodies."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import exchange as X
from ..operators import grid as G
from ..operators import impact, lineage, series, solver
from ..operators import pairs as P
from ..sources import binary, scenes, sinks, states, tables, topology
from ..streaming import live
from .registry import BODY, bodies, query, table
from .space_queries import _OVERLAP, _PAIRS, CELLS, LOW, WIDTH

_INT = "CAST({} AS INTEGER)".format


def _states(spark, sf):
    zero, one = F.lit(0.0), F.lit(1.0)
    return bodies(spark, sf).select(
        F.lit("a").alias("sim_id"), F.col("body_nr").alias("state_nr"), (F.col("body_nr") / F.lit(10.0)).alias("t"), F.col("id").alias("body_id"),
        F.array("x", "y", "z", zero, zero, zero, one).alias("q"), F.array("mass", zero, zero, zero, zero, "r").alias("u"),
    )


@query(
    f"""WITH {BODY} SELECT sim_id, body_nr AS state_nr, count(*) AS bodies, sum(x + y + z) AS places, sum(mass) AS speed FROM body, (VALUES ('a'), ('b')) s(sim_id) GROUP BY sim_id, body_nr""", "ours"
)
def state_store(spark, sf):
    """A store is written, a second simulation appended, and a layout that doesn't fit is refused; both are read as one."""
    path, rows = lineage.scratch(spark, "states"), _states(spark, sf)
    states.write(rows, path)
    if not states.append(rows.withColumn("sim_id", F.lit("b")), path) or states.append(rows, path, nq=5):
        raise RuntimeError("the store takes its own layout only")
    read = states.read(spark, path)
    return read.groupBy("sim_id", "state_nr").agg(F.count(F.lit(1)).alias("bodies"), F.sum(F.col("q")[0] + F.col("q")[1] + F.col("q")[2]).alias("places"), F.sum(F.col("u")[0]).alias("speed"))


@query("SELECT * FROM (VALUES ('a', true), ('b', true)) v(sim_id, filled)", "ours")
def state_catalog(spark, sf):
    path, rows = lineage.scratch(spark, "states"), _states(spark, sf)
    states.write(rows.unionByName(rows.withColumn("sim_id", F.lit("b"))), path)
    files = states.catalog(spark, path)
    return files.groupBy(F.regexp_extract("path", "sim_id=([^/]*)", 1).alias("sim_id")).agg((F.sum("length") > 0).alias("filled"))


_STATES = "SELECT CAST(s AS BIGINT) AS state_nr, CAST(s AS DOUBLE) / 2 AS t, CAST(p_partkey AS BIGINT) AS body_id, CAST(p_size AS DOUBLE) AS x, CAST(s AS DOUBLE) * p_partkey AS w FROM part, range(0, 5) AS r(s)"


def _part_states(spark, sf):
    """All parts as bodies in five states."""
    rows = table(spark, sf, "part").withColumn("state_nr", F.explode(F.sequence(F.lit(0), F.lit(4))))
    zeros = lambda n: [F.lit(0.0)] * n
    return rows.select(
        F.lit("parts").alias("sim_id"), "state_nr", (F.col("state_nr") / 2).alias("t"), F.col("p_partkey").alias("body_id"),
        F.array(F.col("p_size").cast("double"), *zeros(6)).alias("q"), F.array(*zeros(5), (F.col("state_nr") * F.col("p_partkey")).cast("double")).alias("u"),
    )


@query(_STATES, "ours")
def state_binary(spark, sf):
    """Binary state files: written by the tasks, read by ranges inside the files."""
    path = lineage.scratch(spark, "binary")
    binary.write_states(_part_states(spark, sf), path)
    return binary.read_states(spark, path, partitionBytes=1 << 20).select("state_nr", "t", "body_id", F.col("q")[0].alias("x"), F.col("u")[5].alias("w"))


@query(f"SELECT * FROM ({_STATES}) WHERE state_nr BETWEEN 1 AND 3 AND body_id < 1000", "ours")
def state_binary_range(spark, sf):
    """States by number, found by bisection in the files."""
    path = lineage.scratch(spark, "binary")
    binary.write_states(_part_states(spark, sf), path)
    read = binary.read_states(spark, path, fromState=1, toState=3, nq=7, nu=6).where("body_id < 1000")
    return read.select("state_nr", "t", "body_id", F.col("q")[0].alias("x"), F.col("u")[5].alias("w"))


@query(f"SELECT * FROM ({_STATES})", "ours")
def state_files(spark, sf):
    """One series from several stores: even and odd states apart."""
    rows, paths = _part_states(spark, sf), [lineage.scratch(spark, "store") for _ in range(2)]
    for k, path in enumerate(paths):
        states.write(rows.where(F.col("state_nr") % 2 == k), path)
    return states.read(spark, *paths).select("state_nr", "t", "body_id", F.col("q")[0].alias("x"), F.col("u")[5].alias("w"))


@query("SELECT CAST(o_orderkey AS DOUBLE) AS corner, CAST(o_custkey AS DOUBLE) AS below, CAST(o_orderkey + o_custkey AS DOUBLE) AS last FROM orders", "ours")
def matrix_binary(spark, sf):
    """Matrices of two rows and three columns, by column, one for each order."""
    path = lineage.scratch(spark, "matrices")
    flat = F.array(*(c.cast("double") for c in (F.col("o_orderkey"), F.col("o_custkey"), F.lit(1), F.lit(2), F.lit(9), F.col("o_orderkey") + F.col("o_custkey"))))
    binary.write_records(table(spark, sf, "orders").select(flat.alias("m")), path, "m:f8[6]")
    m = states.read_matrices(spark, path, 2, 3)
    return m.select(F.col("matrix")[0][0].alias("corner"), F.col("matrix")[1][0].alias("below"), F.col("matrix")[1][2].alias("last"))


@query("SELECT r_name AS region, n_name AS line FROM nation JOIN region ON r_regionkey = n_regionkey")
def text_lines(spark, sf):
    path = lineage.scratch(spark, "lines")
    named = table(spark, sf, "nation").join(table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    sinks.lines(named, "n_name", path, file_col="r_name")
    return spark.read.text(path).select(F.col("r_name").alias("region"), F.col("value").alias("line"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name, s_acctbal AS balance FROM supplier")
def xml_scene(spark, sf):
    """Rows are written as elements, and read under an explicit schema."""
    path = lineage.scratch(spark, "scene")
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    sinks.xml(rows, path, "SceneObjects", "RigidBodies")
    return tables.scene(spark, path, "RigidBodies", "_id long, name string, balance double").select(F.col("_id").alias("id"), "name", "balance")


@query(f"WITH {_PAIRS} SELECT count(*) AS contacts, round(greatest(0, coalesce(max(overlap), 0)), 6) AS max_overlap FROM contact")
def metrics_line(spark, sf):
    return sinks.metrics(P.overlaps(bodies(spark, sf))).select("contacts", F.round("max_overlap", 6).alias("max_overlap"))


_HEAD = """'<Topology type="', {kind}, '" buildMode="auto" time="', n_nationkey / 2, '"><Description><Run>r', n_nationkey, '</Run><Note/></Description>'"""
_EYE = "1 0 0\\n0 0 -1\\n0 1 0"


@query(
    """
SELECT n_nationkey AS id, 'Grid' AS kind, 'auto' AS build_mode, CAST(n_nationkey AS DOUBLE) / 2 AS time, concat('r', n_nationkey) AS run, CAST(n_regionkey AS BIGINT) AS rank,
       CAST(n_nationkey AS DOUBLE) AS high, CAST(2 AS INTEGER) AS boxes, CAST(1 + n_regionkey AS INTEGER) AS points, CAST(5 AS DOUBLE) AS y,
       CAST(3.5 AS DOUBLE) AS distances, CAST(n_regionkey AS DOUBLE) AS mean, CAST(0.5 AS DOUBLE) AS deviation
FROM nation
"""
)
def topology_parse(spark, sf):
    """Documents of several lines, with comments, of a box list, points and distances each."""
    doc = f"""concat({_HEAD.format(kind="'Grid'")}, '<AABBList># rank, box\\n', n_regionkey, ' 0 0 0 1 ', n_nationkey, ' 1\\n\\n7 0 0 0 1 1 1 # last\\n</AABBList><Points>4 5 6',
      repeat('\\n1 2 3', n_regionkey), '</Points><NearestDistanceHistogram mean="', n_regionkey, '" stdDeviation="0.5">1 2.5</NearestDistanceHistogram></Topology>')"""
    t = topology.topology(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.expr(doc).alias("xml")))
    return t.select(
        "id", "kind", "build_mode", "time", F.col("description")["Run"].alias("run"), F.col("boxes")[0]["rank"].alias("rank"), F.col("boxes")[0]["max"][1].alias("high"), F.size("boxes").alias("boxes"),
        F.size("points").alias("points"), F.col("points")[0][1].alias("y"), F.aggregate("distances", F.lit(0.0), lambda a, x: a + x).alias("distances"), "mean", F.col("std_deviation").alias("deviation"),
    )


@query(
    """
SELECT n_nationkey AS id, CAST(n_nationkey AS DOUBLE) / 2 AS middle, CAST(n_regionkey + 1 AS INTEGER) AS cells, n_regionkey % 2 = 0 AS aligned,
       round(sqrt(0.5::DOUBLE), 6) AS w, round(sqrt(0.5::DOUBLE), 6) AS x FROM nation
"""
)
def grid_topology_parse(spark, sf):
    """Grids turned by a quarter about x."""
    doc = f"""concat({_HEAD.format(kind="'Grid'")}, '<Grid aligned="', if(n_regionkey % 2 = 0, if(n_regionkey = 0, 'true', 'True'), 'false'), '"><Dimension>2 ', n_regionkey + 1, ' 1</Dimension>',
      '<MinPoint>0 0 0</MinPoint><MaxPoint>', n_nationkey, ' 4 6</MaxPoint><A_IK>{_EYE}</A_IK></Grid></Topology>')"""
    g = topology.grid_topology(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.expr(doc).alias("xml")))
    return g.select("id", F.col("center")[0].alias("middle"), F.col("dimension")[1].alias("cells"), "aligned", F.round(F.col("rotation")[3], 6).alias("w"), F.round(F.col("rotation")[0], 6).alias("x"))


@query(
    """
SELECT n_regionkey AS region, CAST(l AS INTEGER) AS level, CAST(count(*) AS INTEGER) AS leaves, CAST(min(n_nationkey) AS INTEGER) AS first, CAST(max(n_nationkey) AS DOUBLE) AS high,
       CAST(sum(CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS points, CAST(l + 1 AS INTEGER) AS boxes
FROM (SELECT *, n_nationkey % 3 AS l FROM nation) GROUP BY n_regionkey, l
"""
)
def tree_topology_parse(spark, sf):
    """A tree for each region, with its nations as leaves on three levels; every other leaf has points."""
    leaf = F.expr("""concat('<Leaf level="', n_nationkey % 3, '" idx="', n_nationkey, '"><AABB>0 0 0 ', n_nationkey, ' 1 1</AABB>', if(n_nationkey % 2 = 0, '<Points>1 2 3\\n4 5 6</Points>', ''), '</Leaf>')""")
    tree = F.concat(
        F.lit(f'<Topology type="KdTree" buildMode="auto" time="1"><Description/><KdTree aligned="true"><Root><AABB>0 0 0 9 9 9</AABB></Root><A_IK>{_EYE}</A_IK><Leafs>'.replace("\\n", "\n")),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", leaf.alias("leaf")))), lambda x: x["leaf"]), ""),
        F.lit("</Leafs><AABBTree>"), *(F.lit(f'<AABBSubTree level="{i}">' + "\n".join(["0 0 0 1 1 1"] * (i + 1)) + "</AABBSubTree>") for i in range(3)), F.lit("</AABBTree></KdTree></Topology>"),
    )
    trees = topology.tree_topology(table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(tree.alias("xml")))
    boxes = trees.select("region", F.explode("subtrees").alias("level", "boxes")).select("region", "level", F.size("boxes").alias("boxes"))
    return topology.leaves_by_level(trees, "region").join(boxes, ["region", "level"]).select(
        "region", "level", F.size("leaves").alias("leaves"), F.col("leaves")[0]["idx"].alias("first"), F.array_max(F.transform("leaves", lambda x: x["max"][0])).alias("high"),
        F.aggregate(F.transform("leaves", lambda x: F.when(x["points"].isNotNull(), F.size(x["points"])).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x).alias("points"), "boxes",
    )


# Every second customer's scene lacks its recorder, every third has two visualizations, every fifth an unknown part.
@query(
    """SELECT c_custkey, 'SceneSettings' AS parent, 'RecorderSettings' AS section, 'missing' AS wrong FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'SceneSettings', 'Visualization', 'repeated' FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'SceneObjects', 'SoftBodies', 'unknown' FROM customer WHERE c_custkey % 5 = 0"""
)
def scene_violations(spark, sf):
    return scenes.violations(_scenes(spark, sf))


@query(
    """SELECT c_custkey, 'SceneObjects' AS parent, 'RigidBodies' AS section, CAST(1 + c_nationkey % 3 AS INTEGER) AS count FROM customer
UNION ALL SELECT c_custkey, 'SceneSettings', 'MPISettings', CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END FROM customer"""
)
def scene_sections(spark, sf):
    return scenes.sections(_scenes(spark, sf)).where("section IN ('RigidBodies', 'MPISettings')")


@query("SELECT c_custkey, '//TimeStepperSettings/@deltaT' AS path, 'positiveDouble' AS domain, CAST(c_nationkey - 2 AS VARCHAR) AS value FROM customer WHERE c_nationkey <= 2")
def scene_domains(spark, sf):
    """Time steps that aren't positive."""
    return scenes.domain_violations(_scenes(spark, sf), {"//TimeStepperSettings/@deltaT": "positiveDouble", "//RigidBodies/@instances": "nonNegativeInt"})


def _scenes(spark, sf):
    xml = F.expr(
        """concat('<DynamicsSystem xmlns="SceneFile"><SceneSettings>', if(c_custkey % 2 = 0, '', '<RecorderSettings mode="everyStep"><X/></RecorderSettings>'), '<TimeStepperSettings deltaT="', c_nationkey - 2, '"/>',
 '<ContactParameterMap><Standard mu="0.3"/></ContactParameterMap><!-- <Old/> -->', repeat('<Visualization></Visualization>', if(c_custkey % 3 = 0, 2, 0)), if(c_nationkey % 2 = 0, '<MPISettings/>', ''),
 '</SceneSettings><SceneObjects>', repeat('<RigidBodies instances="4"><Visualization><Mesh/></Visualization></RigidBodies>', 1 + c_nationkey % 3), if(c_custkey % 5 = 0, '<SoftBodies/>', ''), '</SceneObjects></DynamicsSystem>')"""
    )
    return table(spark, sf, "customer").select("c_custkey", xml.alias("xml"))


@query(f"WITH {BODY} SELECT id, x AS px, y AS py, round(sqrt(0.5::DOUBLE), 6) AS qz FROM body")
def transform_steps(spark, sf):
    """Along x, a quarter turn about z, then along the turned x."""
    step = lambda by, deg, rad: F.struct(V.vec(F.col(by), 0, 0).alias("trans"), V.vec(0, 0, 1).alias("axis"), F.lit(deg).cast("double").alias("deg"), F.lit(rad).cast("double").alias("rad"))
    b = bodies(spark, sf).withColumn("t", tables.transform_sequence(F.array(step("x", 90.0, 7.0), step("y", None, 0.0))))
    return b.select("id", F.round(F.col("t.position")[0], 6).alias("px"), F.round(F.col("t.position")[1], 6).alias("py"), F.round(F.col("t.rotation")[2], 6).alias("qz"))


@query(f"WITH {BODY} SELECT count(*) AS vertices, sum(x) AS x, sum(z) AS z, CAST(sum(CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS faces FROM body")
def obj_mesh(spark, sf):
    """A vertex for each body, a face of four corners for each fifth and one of three, which is left out, for the rest."""
    path = lineage.scratch(spark, "mesh")
    line = F.concat_ws("\n", F.concat_ws(" ", F.lit("v"), "x", "y", "z"), F.when(F.col("id") % 5 == 0, F.lit("f 1/1/1 2/2/2 3/3/3 4/4/4")).otherwise(F.lit("f 1 2 3")))
    sinks.lines(bodies(spark, sf).withColumn("line", line), "line", path)
    m = tables.mesh(spark, path)
    v = m["vertices"].agg(F.count(F.lit(1)).alias("vertices"), F.sum(F.col("v")[0]).alias("x"), F.sum(F.col("v")[2]).alias("z"))
    return v.crossJoin(m["faces"].agg(F.count(F.lit(1)).alias("faces")))  # one row each


@query(f"WITH {BODY}, s AS (SELECT group_nr, min(id) AS first FROM body WHERE group_nr % 3 <> 0 GROUP BY group_nr) SELECT id, CASE WHEN first IS NOT NULL THEN first * 2 END AS scale FROM body LEFT JOIN s USING (group_nr)")
def first_settings(spark, sf):
    b = bodies(spark, sf)
    settings = b.where("group_nr % 3 <> 0").select("group_nr", (F.col("id") * 2).alias("scale"), F.col("id").alias("nr"))
    return tables.first_of_group(b.select("id", "group_nr"), settings, "nr").select("id", "scale")


@query(f"WITH {BODY} SELECT mat AS mat_lo, mat AS mat_hi, arg_min(mass, id) AS mu FROM body GROUP BY mat")
def first_parameters(spark, sf):
    p = bodies(spark, sf).select(F.col("mat").alias("mat_lo"), F.col("mat").alias("mat_hi"), F.col("mass").alias("mu"), "id")
    return P.first_wins(p, "id").select("mat_lo", "mat_hi", "mu")


@query(f"WITH {BODY} SELECT id, round(x - y, 6) AS tx, round(y + x, 6) AS ty, z + 3.0 AS tz FROM body")
def homogeneous_apply(spark, sf):
    """The matrix of a quarter turn about z and a shift by (x, y, 3), applied to the body's place."""
    m = V.homogeneous(V.vec(0, 0, 0.5**0.5, 0.5**0.5), V.vec(F.col("x"), F.col("y"), 3))
    b = bodies(spark, sf).withColumn("m", m)
    row = lambda i: F.round(F.col("m")[i][0] * F.col("x") + F.col("m")[i][1] * F.col("y") + F.col("m")[i][2] * F.col("z") + F.col("m")[i][3], 6)
    return b.select("id", row(0).alias("tx"), row(1).alias("ty"), row(2).alias("tz"))


@query(f"WITH {BODY} SELECT id, CASE WHEN x > y AND x > z THEN 2.0 WHEN y > x AND y > z THEN x ELSE 1.0 END::DOUBLE AS m00, CASE WHEN x > y AND x > z THEN 1.0 WHEN y > x AND y > z THEN 2.0 ELSE x END::DOUBLE AS m02 FROM body")
def z_axis_up(spark, sf):
    """Rows (1, 2, x), (3, 4, y), (5, 6, z)."""
    m = V.upright(F.array(V.vec(1, 2, F.col("x")), V.vec(3, 4, F.col("y")), V.vec(5, 6, F.col("z"))))
    return bodies(spark, sf).withColumn("m", m).select("id", F.col("m")[0][0].alias("m00"), F.col("m")[0][2].alias("m02"))


@query(f"WITH {BODY} SELECT id, id % 4 = 0 AS finite, x * y <= 1e-6::DOUBLE AS signed, abs(x * y) <= 1e-6::DOUBLE AS both, abs(x * y) < 1e-3::DOUBLE AS contact_frame FROM (SELECT id, x - 18 AS x, y - 20 AS y FROM body)")
def frame_checks(spark, sf):
    """Finite values, and axes whose first two have the inner product x y (the others none)."""
    b = bodies(spark, sf).withColumns({"x": F.col("x") - 18, "y": F.col("y") - 20})
    odd = F.when(F.col("id") % 4 == 0, 1.0).when(F.col("id") % 4 == 1, float("nan")).when(F.col("id") % 4 == 2, float("inf")).otherwise(float("-inf"))
    axes = F.array(V.vec(F.col("x"), 0, 0), V.vec(F.col("y"), 0, 0), V.vec(0, 0, 1))
    return b.select("id", V.is_finite(V.vec(0, odd)).alias("finite"), V.is_orthogonal(axes, signed=True).alias("signed"), V.is_orthogonal(axes).alias("both"), V.is_contact_frame(axes).alias("contact_frame"))


@query(f"WITH {BODY} SELECT id, false AS overlaps FROM body WHERE id % 3 <> 0")
def stale_removed(spark, sf):
    return G.stale_removed(bodies(spark, sf).select("id", (F.col("id") % 3 != 0).alias("in_neighbour_map"), F.lit(True).alias("overlaps"))).select("id", "overlaps")


@query(f"WITH {_OVERLAP}, w AS (SELECT id, cell_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY id) AS w FROM part_cell) SELECT id, cell_id, round(w * mass, 9) AS h, round(1 / mass / w, 9) AS inverse FROM w JOIN body USING (id)", "ours")
def weighed_parts(spark, sf):
    """Forces and inverse masses of the parts of split bodies; their sums over the parts give the whole body back."""
    parts = G.split_weights(G.cells_overlapped(bodies(spark, sf), LOW, WIDTH, CELLS).select("id", "cell_id", "mass"))
    h, inverse = G.weigh(F.array("mass"), F.array(F.lit(1.0) / F.col("mass")), F.col("weight"))
    return parts.select("id", "cell_id", F.round(h[0], 9).alias("h"), F.round(inverse[0], 9).alias("inverse"))


@query(f"WITH {BODY} SELECT id, greatest(x, y, z) AS largest, x + y + z AS total, x*x + y*y + z*z AS squares FROM body")
def residual_strategies(spark, sf):
    v = F.array("x", "y", "z")
    return bodies(spark, sf).select("id", *(solver.residual_strategy(v, s).alias(n) for s, n in (("max", "largest"), ("sum", "total"), ("sum2", "squares"))))


@query(f"WITH {_PAIRS}, e AS (SELECT id1 AS id FROM contact UNION SELECT id2 FROM contact) SELECT count(*) AS bodies, 0::BIGINT AS clashes FROM e")
def node_colours(spark, sf):
    """Colours of the contact graph: how many bodies have one, and how many contacts join two of one colour."""
    contacts = P.overlaps(solver.coloured(bodies(spark, sf)), ("colour",))
    ends = contacts.select(F.explode(F.array("id1", "id2")).alias("id"), (F.col("colour1") == F.col("colour2")).cast("long").alias("clash"))
    each = ends.groupBy("id").agg(F.sum("clash").alias("clashes"))
    return each.agg(F.count(F.lit(1)).alias("bodies"), F.coalesce(F.expr("sum(clashes) div 2"), F.lit(0).cast("long")).alias("clashes"))


@query(f"WITH {BODY} SELECT id, round(z + 3 * 0.5 * mass - 6 * 0.25, 6) AS z, CAST(3 AS INTEGER) AS hooks FROM body", "ours")
def step_loop(spark, sf):
    """Three steps of motion with a speed that falls by 0.5 a step, and a hook after each."""
    state = bodies(spark, sf).select("id", "z", F.col("mass").alias("v"), F.lit(0).alias("hooks"))
    step = lambda s, n: s.withColumn("v", F.col("v") - 0.5).withColumn("z", F.col("z") + F.col("v") * 0.5)
    out = solver.run_steps(state, step, 3, hooks=[lambda s: s.withColumn("hooks", F.col("hooks") + 1)])
    return out.select("id", F.round("z", 6).alias("z"), "hooks")


@query("SELECT p_partkey, p_partkey % 3 <> 0 AS ok, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END AS a, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS BIGINT) END AS b FROM part")
def parse_pair(spark, sf):
    p = S.parse_pair(F.expr("concat(' ', p_partkey, ',', p_size, CASE WHEN p_partkey % 3 = 0 THEN ',1' ELSE ' ' END)"))
    return table(spark, sf, "part").withColumn("p", p).select("p_partkey", "p.ok", "p.a", "p.b")


@query(
    f"""WITH {BODY}, i AS (SELECT id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z FROM body), w AS (SELECT *, CAST(greatest(len(CAST(x AS VARCHAR)), len(CAST(y AS VARCHAR)), len(CAST(z AS VARCHAR))) AS INTEGER) AS w FROM i)
SELECT id, concat_ws(' ', x, y, z) || chr(10) || '0 1 0' AS text, concat_ws(', ', x, y, z) || chr(10) || '0, 1, 0' AS comma,
  '[' || concat_ws(', ', lpad(CAST(x AS VARCHAR), w, ' '), lpad(CAST(y AS VARCHAR), w, ' '), lpad(CAST(z AS VARCHAR), w, ' ')) || ';' || chr(10) || ' ' || concat_ws(', ', lpad('0', w, ' '), lpad('1', w, ' '), lpad('0', w, ' ')) || ']' AS matlab FROM w"""
)
def matrix_text(spark, sf):
    rows = F.array(F.array(*(F.col(c).cast("long") for c in "xyz")), F.array(*(F.lit(v).cast("long") for v in (0, 1, 0))))
    return bodies(spark, sf).select("id", V.matrix_text(rows).alias("text"), V.matrix_text(rows, "comma").alias("comma"), V.matrix_text(rows, "matlab").alias("matlab"))


@query(f"WITH {BODY} SELECT id, 3 + id % 2 AS parts, CAST(1 AS BIGINT) AS multiplicity, round(mass / (3 + id % 2), 9) AS h_part, round((3 + id % 2) / mass, 9) AS inverse_part, round(mass, 6) AS h, round(1 / mass, 9) AS inverse FROM body")
def split_and_whole(spark, sf):
    """Bodies to split weighting and back."""
    b = bodies(spark, sf).withColumns({"parts": F.lit(3) + F.col("id") % 2, "multiplicity": F.lit(1).cast("long"), "h": F.array("mass"), "inverse_mass": F.array(F.lit(1.0) / F.col("mass"))})
    split = G.to_split(b.select("id", "mass", "parts", "multiplicity", "h", "inverse_mass", (F.lit(1.0) / F.col("parts")).alias("part_weight")))
    kept = split.withColumns({"parts": F.col("multiplicity"), "h_part": F.round(F.col("h")[0], 9), "inverse_part": F.round(F.col("inverse_mass")[0], 9)})
    whole = G.to_whole(kept, F.array(F.lit(1.0) / F.col("mass")))
    return whole.select("id", "parts", "multiplicity", "h_part", "inverse_part", F.round(F.col("h")[0], 6).alias("h"), F.round(F.col("inverse_mass")[0], 9).alias("inverse"))


@query(
    """SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ' ' ORDER BY l_quantity > 25, l_linenumber) AS lines FROM lineitem GROUP BY l_orderkey HAVING count(*) = count(DISTINCT l_linenumber)"""
)
def moved_to_back(spark, sf):
    """The lines of each order, those of large quantities behind the others."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("l"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_linenumber").alias("d"))
    return rows.where("n = d").select("l_orderkey", F.transform(series.moved_back(F.col("l"), lambda x: x["l_quantity"] > 25), lambda x: x["l_linenumber"].cast("string")).alias("lines")).withColumn("lines", F.array_join("lines", " "))


@query(f"WITH {BODY} SELECT id, CASE WHEN id % 2 = 0 THEN 'Sphere , radius: ' || r ELSE 'Box,  extent: 1.0' || chr(10) || '2.0' || chr(10) || '3.0' END AS line FROM body")
def geometry_lines(spark, sf):
    kind = F.when(F.col("id") % 2 == 0, "sphere").otherwise("box")
    return bodies(spark, sf).select("id", S.geometry_text(kind, F.col("r"), V.vec(1, 2, 3)).alias("line"))


@query("SELECT s_suppkey, 'Surface' || chr(10) || 'Color ' || s_nationkey || chr(10) AS material, s_nationkey % 3 = 1 AS green, CAST(s_suppkey % 256 AS BIGINT) AS low_byte, [x + 5 for x in range(4)]::BIGINT[] AS span FROM supplier")
def small_values(spark, sf):
    """Material lines, a palette entry, the lowest byte of a packed depth, and a range with a start."""
    key = F.col("s_suppkey")
    colour = S.palette((F.col("s_nationkey") % 3).cast("int"), [(1, 0, 0), (0, 1, 0), (0, 0, 1)])
    depth = S.packed_depth((key % 65536) / F.lit(float(1 << 24)))
    return table(spark, sf, "supplier").select(
        "s_suppkey", S.material_text(F.array(F.lit("Surface"), F.concat(F.lit("Color "), F.col("s_nationkey").cast("string")))).alias("material"), (colour["green"] == 1).alias("green"),
        depth[2].alias("low_byte"), F.sequence(F.lit(5).cast("long"), F.lit(8).cast("long")).alias("span"),
    )


@query(
    f"""WITH {_PAIRS}, n AS (SELECT id1, id2, ax, ar, dx / d AS nx, dz / d AS nz FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS d FROM (
  SELECT id1, id2, a.x AS ax, a.r AS ar, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM contact JOIN body a ON a.id = id1 JOIN body b ON b.id = id2)))
SELECT id1, id2, round(nx, 6) + 0.0 AS nx, round(CASE WHEN abs(nx) > abs(nz) THEN -nz / sqrt(nx*nx + nz*nz) ELSE 0 END, 6) + 0.0 AS ex, round(ax + ar * nx, 6) AS px FROM n"""
)
def contact_frames(spark, sf):
    f = P.contact_frames(P.overlaps(bodies(spark, sf), ("x", "y", "z", "r")))
    first = f.select("id1", "id2", F.col("e_z")[0].alias("nx"), F.col("e_x")[0].alias("ex"), F.col("p")[0].alias("px"))
    return first.select("id1", "id2", *((S.rounded(F.col(c)) + 0.0).alias(c) for c in ("nx", "ex")), S.rounded(F.col("px")).alias("px"))


_AT = "CAST(greatest(0, least(7, floor({} / 5))) AS BIGINT) + 8 * (CAST(greatest(0, least(6, floor(y / 6))) AS BIGINT) + 7 * CAST(greatest(0, least(6, floor(z / 7))) AS BIGINT))".format
_MOVES = f"SELECT id, {_AT('x')} AS from_cell, {_AT('(x + 0.1 * mass)')} AS to_cell FROM body"


def _moving(spark, sf):
    return bodies(spark, sf).withColumns({"vx": F.col("mass"), "vy": F.lit(0.0), "vz": F.lit(0.0)})


@query(f"WITH {BODY} SELECT * FROM ({_MOVES}) WHERE from_cell <> to_cell", "ours")
def body_migration(spark, sf):
    return X.migrations(_moving(spark, sf), 0.1, LOW, WIDTH, CELLS)


@query(f"WITH {_OVERLAP} SELECT o3.id, owner AS owner_cell, cell_id FROM part_cell JOIN (SELECT DISTINCT id, owner FROM o3) o3 ON o3.id = part_cell.id WHERE NOT is_owner", "ours")
def halo_replicas(spark, sf):
    return X.replicas(bodies(spark, sf), LOW, WIDTH, CELLS)


@query(
    f"""WITH {_OVERLAP}, m AS (SELECT from_cell AS sender, to_cell AS receiver, 4 AS flag FROM ({_MOVES}) WHERE from_cell <> to_cell
  UNION ALL SELECT o3.owner, cell_id, 16 FROM part_cell JOIN (SELECT DISTINCT id, owner FROM o3) o3 ON o3.id = part_cell.id WHERE NOT is_owner)
SELECT sender, receiver, CAST(bit_or(flag) AS INTEGER) AS flags, count(*) AS bodies FROM m GROUP BY sender, receiver""", "ours"
)
def cell_messages(spark, sf):
    return X.messages(X.migrations(_moving(spark, sf), 0.1, LOW, WIDTH, CELLS), X.replicas(bodies(spark, sf), LOW, WIDTH, CELLS))


_E3 = "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings"


def _e3(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))


@query(f"SELECT vec_id, greatest(z, 0) AS pn, round(CASE WHEN t > 0.5 * greatest(z, 0) THEN x * 0.5 * greatest(z, 0) / t ELSE x END, 6) + 0.0 AS px FROM (SELECT *, sqrt(x*x + y*y) AS t FROM ({_E3}))", "ours")
def prox_rplus_disk(spark, sf):
    p = _e3(spark, sf).withColumn("p", S.prox_disk_scaled(F.col("z"), F.col("x"), F.col("y"), 0.5))
    return p.select("vec_id", F.col("p")[0].alias("pn"), (F.round(F.col("p")[1], 6) + 0.0).alias("px"))


@query(f"SELECT vec_id, round(CASE WHEN n > 0.1 THEN x * 0.1 / n ELSE x END, 6) + 0.0 AS px, round(CASE WHEN n > 0.05 THEN x * 0.05 / n ELSE x END, 6) + 0.0 AS hx FROM (SELECT *, sqrt(x*x + y*y + z*z) AS n FROM ({_E3}))", "ours")
def prox_ellipsoids(spark, sf):
    """Ellipsoids with equal half axes, whose nearest points SQL can tell too; a test covers unequal ones."""
    v = V.vec(F.col("x"), F.col("y"), F.col("z"))
    p = _e3(spark, sf).select("vec_id", S.prox_ellipsoid(v, V.vec(0.1, 0.1, 0.1)).alias("p"), S.prox_half_line_ellipsoid(F.lit(0.5), v, V.vec(0.1, 0.1, 0.1)).alias("h"))
    return p.select("vec_id", (F.round(F.col("p")[0], 6) + 0.0).alias("px"), (F.round(F.col("h")[1], 6) + 0.0).alias("hx"))


# Streams: a table is played back some files at a time, and what a query writes is read.
def _played(spark, sf, columns):
    path = lineage.scratch(spark, "frames")
    rows = table(spark, sf, "events").select(*columns)
    rows.repartitionByRange(4, "ts").write.parquet(path)
    return live.playback(spark, path, T.StructType(rows.schema.fields), files_per_batch=4)


@query("SELECT event_id, user_id, value FROM events WHERE event_id % 3 = 0")
def stream_record(spark, sf):
    out = lineage.scratch(spark, "recorded")
    states_ = _played(spark, sf, ["event_id", "user_id", "value", "ts"])
    running = live.record(states_, out, f"{out}-progress", step="event_id", x=3)
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.parquet(out).select("event_id", "user_id", "value")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
s AS (SELECT user_id, n, t AS last, 1 AS frames FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, CASE WHEN (e.t - s.last) * 0.0001::DOUBLE >= 1 THEN e.t ELSE s.last END, s.frames + CASE WHEN (e.t - s.last) * 0.0001::DOUBLE >= 1 OR e.t = s.last THEN 1 ELSE 0 END
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, CAST(max(frames) AS BIGINT) AS frames FROM s GROUP BY user_id"""
)
def stream_frames(spark, sf):
    out = lineage.scratch(spark, "sampled")
    frames = _played(spark, sf, ["user_id", "ts"]).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))
    running = live.sampled(frames, "user_id", "t", 0.0001).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress").outputMode("append").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.parquet(out).groupBy(F.col("key").alias("user_id")).agg(F.max("frame").alias("frames"))


@query(
    """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""", "extension"
)
def event_sessions(spark, sf):
    out = live.sessions(table(spark, sf, "events"), "ts", "6 hours", "user_id")
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes' * k AS start, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES (0), (1)) v(k) GROUP BY 1", "extension")
def event_window_sliding(spark, sf):
    out = live.windows(table(spark, sf, "events"), "ts", "1 hour", "30 minutes")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


# Most events arrive in the batch of their five days, every tenth one later, every fiftieth three later.
_ARRIVALS = """e AS (SELECT *, (day(ts) - 1) // 5 + CASE WHEN event_id % 50 = 7 THEN 3 WHEN event_id % 10 = 3 THEN 1 ELSE 0 END AS b FROM events),
wm AS (SELECT b, max(max(ts)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS w FROM e GROUP BY b),
fin AS (SELECT max(ts) - INTERVAL 2 DAY AS w FROM e),
s AS (SELECT e.*, date_trunc('day', ts) AS day, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= wm.w, false) AS late, date_trunc('day', ts) + INTERVAL 1 DAY <= fin.w AS closed FROM e JOIN wm USING (b), fin)"""


def _arriving(spark, sf):
    delay = F.when(F.col("event_id") % 50 == 7, 3).when(F.col("event_id") % 10 == 3, 1).otherwise(0)
    return table(spark, sf, "events").withColumn("b", F.floor((F.dayofmonth("ts") - 1) / 5) + delay)


def _played_out(rows, out, transform):
    live.play(rows, "b", f"{out}-arrived", lambda stream: transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress").outputMode("append"))
    return rows.sparkSession.read.parquet(out)


@query(f"WITH {_ARRIVALS} SELECT day AS start, count(*) AS n, round(sum(value), 4) AS total FROM s WHERE closed AND NOT late GROUP BY day", "extension")
def stream_windows_late(spark, sf):
    """Daily windows of a stream out of order: rows behind the watermark are dropped, windows that it hasn't reached stay open."""
    out = lineage.scratch(spark, "windows")
    found = _played_out(_arriving(spark, sf), out, lambda s: live.windows(s, "ts", "1 day", late="2 days"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query(
    f"""WITH {_ARRIVALS} SELECT user_id % 8 AS users, 'window' AS kind, day AS start, count(*) AS n, round(sum(value), 4) AS total FROM s WHERE closed AND NOT late GROUP BY user_id % 8, day
UNION ALL SELECT user_id % 8, 'late', ts, 1, round(value, 4) FROM s WHERE late""", "extension"
)
def stream_late_rows(spark, sf):
    """The same by eighths of the users, with timers of one's own: late rows are handed on, not dropped."""
    out = lineage.scratch(spark, "late")
    rows = _arriving(spark, sf).withColumn("users", F.col("user_id") % 8)
    found = _played_out(rows, out, lambda s: live.windows_with_late_rows(s, "ts", "value", "users", 86_400_000_000, "2 days"))
    return found.select(F.col("key").alias("users"), "kind", F.timestamp_micros("t").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


def _impacts(spark, sf):
    b = bodies(spark, sf)
    contacts = P.contact_frames(P.overlaps(b).select("id1", "id2"), b).withColumns({"mu": F.lit(0.3), "restitution": F.lit(0.5)})
    return contacts, b.select("id", "mass", F.array(*((F.lit(20.0) - F.col(c)) / 10 for c in "xyz")).alias("u"))


@query(f"WITH {_PAIRS} SELECT count(*) AS contacts, true AS settled, 0::BIGINT AS pulling, 0::BIGINT AS beyond_friction FROM contact", "ours")
def percussion_laws(spark, sf):
    """Percussions of all contacts of a scene: they settle, never pull, and stay within the friction cone."""
    found = impact.percussions(*_impacts(spark, sf))
    n, t = F.col("p")[0], F.hypot(F.col("p")[1], F.col("p")[2])
    return found.agg(F.count(F.lit(1)).alias("contacts"), F.bool_and("settled").alias("settled"), F.count_if(n < 0).alias("pulling"), F.count_if(t > 0.3 * n + 1e-9).alias("beyond_friction"))


@query(None, "ours")
def percussions(spark, sf):
    out = impact.percussions(*_impacts(spark, sf))
    return out.select("id1", "id2", *(F.round(F.col("p")[i], 5).alias(c) for i, c in enumerate(("normal", "tangent_x", "tangent_y"))), "settled")

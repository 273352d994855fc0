"""Pair search between bodies: brute force, by grid cells, against static bodies, and what is computed from contacts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..functions.ids import pair_key
from . import blocks, cells

#: Standard contact parameters, for material pairs without their own.
STANDARD = {"epsilon_n": 0.5, "epsilon_t": 0.5, "mu": 0.3}

_BODY = ("id", "x", "y", "z", "r")
#: Bodies that are compared with all others of a chunk, about.
CHUNK = 256


def _side(bodies: DataFrame, suffix: str) -> DataFrame:
    return bodies.select(*(F.col(c).alias(f"{c}_{suffix}") for c in _BODY))


def _distance2() -> Column:
    d = [F.col(f"{c}_b") - F.col(f"{c}_a") for c in "xyz"]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def _touch() -> Column:
    reach = F.col("r_a") + F.col("r_b")
    return _distance2() < reach * reach


def _contact_columns() -> list[Column]:
    return [F.col("id_a").alias("id1"), F.col("id_b").alias("id2"), (F.col("r_a") + F.col("r_b") - F.sqrt(_distance2())).alias("overlap")]


def overlaps_brute(bodies: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Contacts (id1 < id2, overlap) of spheres by comparing all pairs, as a yardstick.

    Bodies are dealt out in chunks that lie together. Each pair of chunks is looked at: where their boxes lie further apart
    than their largest bodies reach no bodies can touch, and everywhere else all pairs are compared.
    """
    depth = blocks.depth_of(bodies.count(), chunk)
    some = bodies.where(F.pmod(F.xxhash64("id"), F.lit(max(1, chunk // 16))) == 0).select(*(F.col(c).cast("double") for c in "xyz")).dropna()
    cuts = blocks.Cuts(np.array(some.collect() if depth else [], dtype=float).reshape(-1, 3), depth, 0)
    # Few files of bodies are dealt out first.
    spread = bodies.select(*_BODY).repartition(int(bodies.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    dealt = spread.withColumn("chunk", F.pandas_udf(cuts.of, "long")(*(F.col(c).cast("double") for c in "xyz"), F.xxhash64("id")) if depth else F.lit(1).cast("long"))
    boxes = dealt.groupBy("chunk").agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))), F.max(F.abs("r")).alias("reach"))
    one, two = (boxes.select(*(F.col(c).alias(f"{c}_{s}") for c in boxes.columns)) for s in "ab")
    away = [F.greatest(F.col(f"low_{c}_b") - F.col(f"high_{c}_a"), F.col(f"low_{c}_a") - F.col(f"high_{c}_b"), F.lit(0.0)) for c in "xyz"]
    reach = F.col("reach_a") + F.col("reach_b")
    apart = sum((d * d for d in away), F.lit(0.0)) > reach * reach * (1 + 1e-9)
    # One row for each chunk, so this join is small.
    near = one.crossJoin(two).where((F.col("chunk_a") <= F.col("chunk_b")) & ~apart).select("chunk_a", "chunk_b")
    side = lambda s: dealt.select(*(F.col(c).alias(f"{c}_{s}") for c in (*_BODY, "chunk")))
    once = (F.col("id_a") < F.col("id_b")) | ((F.col("chunk_a") < F.col("chunk_b")) & (F.col("id_a") != F.col("id_b")))
    pairs = side("a").join(near, "chunk_a").join(side("b").hint("shuffle_hash"), "chunk_b").where(once & _touch())
    return pairs.select(*_contact_columns()).withColumns({"id1": F.least("id1", "id2"), "id2": F.greatest("id1", "id2")})


def overlaps(bodies: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same contacts by grid cells, one grid for each class of radii; columns in ``keep`` come along as those of body 1 and 2 (``mat1``, ``mat2``).

    A class holds the bodies whose diameters lie within a factor of two, and its cells are half as wide as the largest of
    them may be. Every body stands in the cell of its centre in the grid of its class and of each larger one. Of two bodies
    the larger looks for the other, in the cells of its class that come within its diameter, 125 at most; so each pair is
    found once, and one giant doesn't put everything into one cell. Bodies are dealt out by blocks of cells, and looked for
    in cells inside the tasks only: what is exchanged follows the bodies, neither cells nor contacts.
    """
    found = [T.StructField(f"id{i}", bodies.schema["id"].dataType) for i in (1, 2)] + [T.StructField("overlap", T.DoubleType())]
    found += [T.StructField(f"{c}{i}", bodies.schema[c].dataType) for c in keep for i in (1, 2)]
    return in_blocks(bodies, keep).mapInArrow(lambda batches: cells.contacts(batches, keep), T.StructType(found))


def in_blocks(bodies: DataFrame, keep: tuple[str, ...] = (), own_class: bool = False, largest: float | None = None) -> DataFrame:
    """Bodies in every block of cells that they stand in or look into (``looks``), of their own class only or of all; dealt out and sorted by ``cells.BLOCK``."""
    largest = largest or bodies.agg(F.max("r")).first()[0] or 0.5
    top = math.ceil(math.log2(2 * largest)) if largest > 0 else 0
    # The smallest bodies share a class, 2**40 below the largest.
    own = F.greatest(F.ceil(F.log2(F.greatest(F.col("r"), F.lit(largest * 2.0**-50)) * 2)).cast("int"), F.lit(top - 40))
    brought = [*_BODY, *(c for c in keep if c not in _BODY)]
    number = lambda c: F.col(c).cast("double").alias(c) if c in _BODY[1:] else F.col(c)
    classed = bodies.where("r >= 0 and abs(x) < double('inf') and abs(y) < double('inf') and abs(z) < double('inf')").select(*map(number, brought), own.alias("own"))
    levels = [] if own_class else sorted(r[0] for r in classed.select("own").distinct().collect())  # 42 at most
    tasks = int(bodies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Few files of bodies are dealt out before they are copied.
    rows = classed.repartition(tasks, "id").withColumn("level", F.col("own") if own_class else F.explode(F.filter(F.array(*map(F.lit, levels)), lambda l: l >= F.col("own"))))
    rows = rows.withColumn("looks", F.col("level") == F.col("own"))
    width = F.pow(F.lit(2.0), F.col("level") - 1) * cells.SPAN
    # A touching body of no larger radius; the little more outweighs all rounding, as the sum itself rounds monotonically.
    reach = F.when(F.col("looks"), F.col("r") * (2 * (1 + 1e-9))).otherwise(0.0)
    if own_class:
        # The larger ones of the class too.
        reach = (F.col("r") + F.pow(F.lit(2.0), F.col("level") - 1)) * (1 + 1e-9)
    at = lambda x: F.floor(x / width).cast("long")
    for c in "xyz":
        rows = rows.withColumn(f"b{c}", F.explode(F.sequence(at(F.col(c) - reach), at(F.col(c) + reach))))
    # Corners of that box which lie beyond the reach are left out.
    away = [F.greatest(F.col(f"b{c}") * width - F.col(c), F.col(c) - (F.col(f"b{c}") + 1) * width, F.lit(0.0)) for c in "xyz"]
    rows = rows.where(sum((d * d for d in away), F.lit(0.0)) <= reach * reach * (1 + 1e-9))
    return rows.select(*cells.BLOCK, "looks", *brought).repartition(tasks, *cells.BLOCK).sortWithinPartitions(*cells.BLOCK)


def with_bodies(contacts: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """Contacts with columns of their bodies: ``one`` has id1, ``two`` has id2. Bodies are dealt out, as they needn't fit the driver."""
    return contacts.join(one.hint("shuffle_hash"), "id1").join(two.hint("shuffle_hash"), "id2")


def overlaps_static(bodies: DataFrame, halfspaces: DataFrame) -> DataFrame:
    """Contacts of spheres with half-spaces (static_id, nx, ny, nz, px, py, pz): overlap = r - n (c - p), where positive.

    The static side is the handful of walls of a scene; Spark broadcasts it below its size threshold.
    """
    gap = sum((F.col(f"n{c}") * (F.col(c) - F.col(f"p{c}")) for c in "xyz"), F.lit(0.0))
    return bodies.join(halfspaces, F.col("r") - gap > 0).select("id", "static_id", (F.col("r") - gap).alias("overlap"))


def contact_tag(id1: Column, type1: Column, feature1: Column, id2: Column, type2: Column, feature2: Column) -> Column:
    """Six-part key of a contact, the side with the smaller id first; equal ids raise."""
    swap = pair_key(id1, id2)["lo"] != id1
    pick = lambda a, b: F.when(swap, b).otherwise(a)
    tag = F.struct(
        pick(id1, id2).alias("id1"), pick(type1, type2).alias("type1"), pick(feature1, feature2).alias("feature1"),
        pick(id2, id1).alias("id2"), pick(type2, type1).alias("type2"), pick(feature2, feature1).alias("feature2"),
    )
    return F.when(id1 == id2, F.raise_error(F.lit("a contact needs two bodies"))).otherwise(tag)


def max_overlap(contacts: DataFrame) -> DataFrame:
    """Largest overlap, 0 without contacts."""
    return contacts.agg(F.greatest(F.lit(0.0), F.coalesce(F.max("overlap"), F.lit(0.0))).alias("max_overlap"))


def overlap_per_body(contacts: DataFrame) -> DataFrame:
    """Sum and number of overlaps of each body that has any."""
    sides = contacts.select(F.explode(F.array("id1", "id2")).alias("id"), "overlap")
    return sides.groupBy("id").agg(F.sum("overlap").alias("total_overlap"), F.count(F.lit(1)).alias("contacts"))


def with_parameters(pairs: DataFrame, parameters: DataFrame, a: str = "mat_a", b: str = "mat_b") -> DataFrame:
    """Adds contact parameters of the unordered material pair (mat_lo, mat_hi in ``parameters``), the standard ones where it has none."""
    keyed = pairs.withColumns({"mat_lo": F.least(a, b), "mat_hi": F.greatest(a, b)})
    joined = keyed.join(parameters, ["mat_lo", "mat_hi"], "left")
    return joined.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in STANDARD.items()})


def first_wins(parameters: DataFrame, order: str) -> DataFrame:
    """One row per material pair: the first by ``order``."""
    rest = [c for c in parameters.columns if c not in ("mat_lo", "mat_hi")]
    least = F.min_by(F.struct(*rest), F.col(order))
    return parameters.groupBy("mat_lo", "mat_hi").agg(least.alias("_")).select("mat_lo", "mat_hi", "_.*")


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default, enabled: Column | None = None) -> DataFrame:
    """Adds ``value`` from ``table`` (key, value), the default only where the key is missing, null where not ``enabled``."""
    known = table.select(key, value).withColumn("_found", F.lit(True))
    found = rows.join(known, key, "left").withColumn(value, F.when(F.col("_found"), F.col(value)).otherwise(F.lit(default))).drop("_found")
    return found if enabled is None else found.withColumn(value, F.when(enabled, F.col(value)))


def carried_forward(rows: DataFrame, value: str, partition: list[str], order: str) -> DataFrame:
    """A disabled lookup keeps its last value: nulls of ``value`` take the latest one before them."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def warm_start(contacts: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Adds the percussion that the previous step left for the same contact, zeros where it had none.

    Without ``previous``, contacts that lasted bring theirs along, which spares a join of all contacts.
    """
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    both = contacts if previous is None else contacts.join(previous.select("id1", "id2", "percussion"), ["id1", "id2"], "left")
    return both.withColumn("percussion", F.coalesce("percussion", zero))


def overlap_by_kind(kind_a: Column, kind_b: Column, of_spheres: Column, of_a_in_b: Column, of_b_in_a: Column) -> Column:
    """Overlap by the kinds of two geometries: sphere with sphere, sphere with half-space either way round; others give null."""
    return (
        F.when((kind_a == "sphere") & (kind_b == "sphere"), of_spheres)
        .when((kind_a == "sphere") & (kind_b == "halfspace"), of_a_in_b)
        .when((kind_a == "halfspace") & (kind_b == "sphere"), of_b_in_a)
    )


def with_neighbours(rows: DataFrame, neighbours: DataFrame, rank: str = "rank") -> DataFrame:
    """Adds a neighbour's data by rank, null where there is none, and whether it was found."""
    return rows.join(neighbours.withColumn("found", F.lit(True)), rank, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def contact_frames(contacts: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """Contacts (id1, id2) of spheres with their frame: e_z from the first body to the second, e_x and e_y across it, and the point on the first one's surface.

    Without ``bodies``, the contacts bring their x, y, z and r along (``overlaps`` keeps them), which spares two joins.
    """
    named = lambda i: bodies.select(*(F.col(c).alias(f"{c}{i}") for c in _BODY))
    both = contacts if bodies is None else with_bodies(contacts.select("id1", "id2"), named(1), named(2))
    # As in V.basis, by way of columns: in one expression each part repeats all parts before it.
    x, y, z, flat = (F.col(c) for c in ("_x", "_y", "_z", "_flat"))
    out = both.withColumns({f"_d{c}": F.col(f"{c}2") - F.col(f"{c}1") for c in "xyz"})
    out = out.withColumn("_length", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy") + F.col("_dz") * F.col("_dz")))
    out = out.withColumns({f"_{c}": F.try_divide(f"_d{c}", "_length") for c in "xyz"})
    out = out.withColumns({"_xz": F.sqrt(x * x + z * z), "_yz": F.sqrt(y * y + z * z), "_flat": F.abs(x) > F.abs(z), "_one": F.sqrt(x * x + y * y + z * z)})
    across = lambda a, b: F.when(flat, a).otherwise(b)
    by = lambda v, length: F.try_divide(v, F.col(length))
    out = out.withColumns({"_ax": across(by(-z, "_xz"), F.lit(0.0)), "_ay": across(F.lit(0.0), by(z, "_yz")), "_az": across(by(x, "_xz"), by(-y, "_yz"))})
    ax, ay, az = (F.col(c) for c in ("_ax", "_ay", "_az"))
    vector = lambda *v: F.when(F.col("_length") > 0, V.vec(*v))
    point = [F.col(f"{c}1") + by(F.col(f"_{c}"), "_one") * F.col("r1") for c in "xyz"]
    e_y = vector(y * az - z * ay, z * ax - x * az, x * ay - y * ax)
    return out.select("id1", "id2", vector(ax, ay, az).alias("e_x"), e_y.alias("e_y"), vector(x, y, z).alias("e_z"), V.vec(*point).alias("p"))

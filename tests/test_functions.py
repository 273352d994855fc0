"""Expressions against known values and properties."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.functions import scalars as S
from tessera.functions import vectors as V
from tessera.sources import tables as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "parse, text, ok, values",
    [
        (lambda t: S.parse_numbers(t), "1 2 3 4 5 6 7 8.5 9.2 10", True, [1, 2, 3, 4, 5, 6, 7, 8.5, 9.2, 10]),
        (lambda t: S.parse_numbers(t, 3), "1 2 3 4 5 6 7 8.5 9.2 10", False, [1, 2, 3]),
        (S.parse_int_set, "1 2 3 4 5 6 7 8.5 9.2 10", False, [1, 2, 3, 4, 5, 6, 7]),
        (lambda t: S.parse_bools(t, 3), "true false true", True, [True, False, True]),
        (S.parse_bools, "0 1 false true ", True, [False, True, False, True]),
        (S.parse_bools, "yes", False, []),
        (S.parse_pairs, "1,3 0,4 0,7 2,3123", True, [4294967299, 4, 7, 8589937715]),
        (S.parse_pairs, "1,3 0,4 0,7 1,2,4", False, [4294967299, 4, 7]),
    ],
)
def test_parsers(spark, parse, text, ok, values):
    found = one(spark, parse(F.lit(text)))
    assert (found["ok"], found["values"]) == (ok, values)


def test_ids(spark):
    packed = ids.pack(F.lit(2**31 + 5), F.lit(7))
    assert one(spark, ids.group_of(packed)) == 2**31 + 5
    assert one(spark, ids.text_of(packed)) == "(2147483653,7)"
    key = one(spark, ids.pair_key(packed, ids.pack(F.lit(1), F.lit(9))))
    assert key["lo"] == (1 << 32) + 9  # a group from 2**31 on is the larger one


def test_angles_and_gcd(spark):
    for x in (-10.0, -math.pi, 0.0, 3.0, 100.0):
        assert -math.pi <= one(spark, S.wrap_pi(F.lit(x))) <= math.pi
        assert 0 <= one(spark, S.wrap_2pi(F.lit(x))) < 2 * math.pi
    for a, b in ((0, 5), (12, -18), (2**62, 6), (832040, 514229), (0, 0)):
        assert one(spark, S.gcd(F.lit(a), F.lit(b))) == math.gcd(a, b)


def lit(values):
    """A value found before, as a literal: nested expressions repeat their parts and grow fast."""
    return F.array(*(lit(v) if isinstance(v, list) else F.lit(v) for v in values))


def test_rotation_keeps_length_and_matrices_agree(spark):
    q, v = lit(one(spark, V.quaternion(V.vec(1, 2, 3), F.lit(0.7)))), V.vec(3, -4, 12)
    assert one(spark, V.norm(V.rotate(q, v))) == pytest.approx(13)
    m = one(spark, V.homogeneous(q, V.vec(1, 2, 3)))
    turned = one(spark, V.transform(q, V.vec(1, 2, 3), v))
    assert [sum(a * b for a, b in zip(row, (3, -4, 12, 1))) for row in m[:3]] == pytest.approx(turned)
    assert one(spark, V.quaternion_of(lit(m))) == pytest.approx(one(spark, q))
    assert one(spark, V.is_orthogonal(lit(one(spark, V.basis(v)))))
    # By hand: the last entries of the rows are (1, 0, 0), (0, 1, 0) and (0, 0, 1) in turn; signs count.
    first, second = F.array(V.vec(2, 3, 1), V.vec(4, 5, 0), V.vec(6, 7, 0)), F.array(V.vec(2, 3, 0), V.vec(4, 5, 1), V.vec(6, 7, -9))
    assert one(spark, V.upright(first)) == [[3, 1, 2], [5, 0, 4], [7, 0, 6]]
    assert one(spark, V.upright(second)) == [[0, 2, 3], [1, 4, 5], [-9, 6, 7]]
    assert one(spark, V.upright(F.array(V.vec(2, 3, 0), V.vec(4, 5, 0), V.vec(6, 7, 1)))) == [[2, 3, 0], [4, 5, 0], [6, 7, 1]]
    assert one(spark, V.basis(V.vec(0, 0, 2))) == [[0, 0, 1], [0, 1, 0], [-1, 0, 0]]
    assert one(spark, V.basis(V.vec(5, 0, 0))) == [[1, 0, 0], [0, 0, 1], [0, -1, 0]]
    assert one(spark, V.box_corners(V.vec(2, 4, 6)))[:3] == [[1, 2, 3], [-1, 2, 3], [1, -2, 3]]
    assert one(spark, S.geometry_text(F.lit("sphere"), F.lit(0.5), V.vec(1, 1, 1))) == "Sphere , radius: 0.5"
    assert not one(spark, V.is_finite(F.array(F.lit(1.0), F.lit(float("inf")))))
    with pytest.raises(Exception):
        one(spark, V.component(v, 3))


# Texts inside and outside of the scalar domains.
DOMAINS = {
    "Vector3": (["1 2 3", " 1.5 -2e3 +3\n"], [".5 1 2", "1. 2 3", "1E5 2 3", "1 2", "1 2 3 4", ""]), "Vector2": (["1 2"], ["1"]), "Vector": (["1 2", "1 2 3 4 5"], ["1"]),
    "VectorInt": (["1", "-1 2"], ["1.0"]), "Vector3UnsignedInt": (["1 2 3"], ["-1 2 3"]), "commaSeperatedPairsOfUnsignedInts": (["1,2", "1,2 3,4"], ["1,2,3", "1, 2"]), "twoCommaSeperatedPairsOfUnsignedInts": (["1,2 3,4"], ["1,2"]),
    "positiveInt": (["1", " 4294967295 "], ["0", "4294967296", "1.0", "-1"]), "nonNegativeInt": (["0", "+7"], ["", "-1"]), "nonNegativeDouble": (["0", "1e-1", "INF", ".5"], ["-0.1", "NaN", "+", "."]),
    "positiveDouble": (["1e-3"], ["0", "0.0e5"]), "zeroToOneDouble": (["0", "1.0", "1e-1"], ["", "+", ".", "1.01"]),
}


def test_domains(spark):
    for domain, (inside, outside) in DOMAINS.items():
        rows = spark.createDataFrame([(t, True) for t in inside] + [(t, False) for t in outside], "t string, fits boolean")
        assert rows.where(S.in_domain(F.col("t"), domain) != F.col("fits")).collect() == [], domain
    assert tuple(one(spark, S.parse_pair(F.lit(" 3,4 ")))) == (True, 3, 4) and tuple(one(spark, S.parse_pair(F.lit("3,4 5,6")))) == (False, None, None)


def test_ellipsoid_prox(spark):
    axes = [2.0, 1.0, 0.5]
    for v in ([3.0, -2.0, 1.0], [0.1, 0.1, 0.1], [0.0, 5.0, 0.0]):
        p = one(spark, S.prox_ellipsoid(lit(v), lit(axes)))
        level = sum((x / a) ** 2 for x, a in zip(v, axes))
        if level <= 1:
            assert p == v
            continue
        assert sum((x / a) ** 2 for x, a in zip(p, axes)) == pytest.approx(1)
        # The way to the nearest point stands upright on the surface.
        rates = [(x - y) * a * a / y for x, y, a in zip(v, p, axes) if abs(y) > 1e-12]
        assert rates == pytest.approx([rates[0]] * len(rates), rel=1e-6) and rates[0] > 0
    assert one(spark, S.prox_ellipsoid(V.vec(3, 1, 0), V.vec(2, 0, 1))) == pytest.approx([2, 0, 0])
    assert one(spark, S.prox_half_line_ellipsoid(F.lit(-1.0), V.vec(3, 1, 0), V.vec(2, 1, 1))) == [0, 0, 0, 0]
    assert one(spark, S.prox_disk_scaled(F.lit(2.0), F.lit(3.0), F.lit(0.0), F.lit(0.5))) == [2, 1, 0]


def test_prox_and_colours(spark):
    assert one(spark, S.prox_cone(F.lit(-1.0), F.lit(0.1), F.lit(0.0), F.lit(0.5))) == [0, 0, 0]
    n, x, _ = one(spark, S.prox_cone(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(1.0)))
    assert (n, x) == pytest.approx((0.5, 0.5))
    assert one(spark, S.color(F.lit(0.125)))["green"] == pytest.approx(0.5)
    assert tuple(one(spark, S.color(F.lit(-3.0)))) == (0, 0, 1)
    assert tuple(one(spark, S.color(F.lit(3.0)))) == (1, 0, 0)
    assert one(spark, S.bits(F.lit(258))) == "00000010 00000001 00000000 00000000"
    assert one(spark, S.inverse_diagonal(F.array(F.lit(2.0), F.lit(0.0)))) == [0.5, None]


def test_transform_sequence(spark):
    schema = "s array<struct<trans: array<double>, axis: array<double>, deg: double, rad: double>>"
    x, z = [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]
    rows = spark.createDataFrame([([(x, z, 90.0, 7.0), (x, z, None, 0.0)],)], schema)
    found = rows.select(T.transform_sequence(F.col("s")).alias("x")).first()["x"]
    assert found["position"] == pytest.approx([1, 1, 0])
    with pytest.raises(Exception, match="zero axis"):
        spark.createDataFrame([([(x, [0.0] * 3, 90.0, 7.0)],)], schema).select(T.transform_sequence(F.col("s"))).collect()

"""Scalar functions: parsing of number lists, angles, gcd, colours, bits, projections onto convex sets."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi

# The scalar domains that scene files may use, as patterns of lists of numbers and as ranges of one number
# (type, least value, whether the least value itself belongs to it, greatest value).
_REAL, _WHOLE, _COUNT, _PAIR = r"[+-]?\d+(\.\d+)?(e[+-]?\d+)?", r"[+-]?\d+", r"\d+", r"\d+,\d+"
_PATTERNS = {
    "Vector2": (_REAL, "{1}"), "Vector3": (_REAL, "{2}"), "Vector4": (_REAL, "{3}"), "Vector": (_REAL, "+"),
    "Vector3Int": (_WHOLE, "{2}"), "Vector4Int": (_WHOLE, "{3}"), "VectorInt": (_WHOLE, "*"),
    "Vector3UnsignedInt": (_COUNT, "{2}"), "Vector4UnsignedInt": (_COUNT, "{3}"), "VectorUnsignedInt": (_COUNT, "*"),
    "commaSeperatedPairsOfUnsignedInts": (_PAIR, "*"), "twoCommaSeperatedPairsOfUnsignedInts": (_PAIR, "{1}"),
}
_RANGES = {
    "nonNegativeInt": ("int", 0, True, 2**32 - 1), "positiveInt": ("int", 0, False, 2**32 - 1), "nonNegativeDouble": ("double", 0, True, float("inf")),
    "positiveDouble": ("double", 0, False, float("inf")), "zeroToOneDouble": ("double", 0, True, 1),
}
_SPACE = r"[ \t\r\n]"


def domain_pattern(domain: str) -> str:
    """The whole text of a value in a list domain, or of any number in a range domain."""
    if domain in _PATTERNS:
        item, times = _PATTERNS[domain]
        return rf"^{_SPACE}*{item}({_SPACE}+{item}){times}{_SPACE}*$"
    number = r"[+-]?\d+" if _RANGES[domain][0] == "int" else r"([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|INF)"
    return rf"^{_SPACE}*{number}{_SPACE}*$"


def in_domain(text: Column, domain: str) -> Column:
    """Whether a text is a value of a domain: by its pattern, and by its value where the domain is a range."""
    fits = text.rlike(domain_pattern(domain).replace("$", r"\z"))
    if domain in _PATTERNS:
        return fits
    _, least, inclusive, most = _RANGES[domain]
    clean = F.regexp_replace(text, _SPACE, "")
    value = F.when(clean == "INF", F.lit(float("inf"))).otherwise(clean.try_cast("double"))
    return fits & F.coalesce((value >= least if inclusive else value > least) & (value <= float(most)), F.lit(False))


def tokens(text: Column) -> Column:
    """White space separated tokens; none for a blank text."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def _prefix(values: Column, most: int | None) -> Column:
    """``struct(ok, values)``: the values before the first null; ok if there is none and no more than ``most``, or exactly as many."""
    first_bad = F.array_position(F.transform(values, lambda x: x.isNull()), True)
    good = F.when(first_bad > 0, F.slice(values, 1, (first_bad - 1).cast("int"))).otherwise(values)
    ok = first_bad == 0
    if most is not None:
        ok = ok & (F.size(values) == most)
        good = F.slice(good, 1, most)
    return F.struct(ok.alias("ok"), good.alias("values"))


def parse_numbers(text: Column, size: int | None = None) -> Column:
    """Doubles of a list; ``size`` fixes how many there must be. What precedes an error is kept."""
    return _prefix(F.transform(tokens(text), lambda t: t.try_cast("double")), size)


def parse_int_set(text: Column) -> Column:
    """Distinct whole numbers of a list up to the first token that isn't one."""
    p = _prefix(F.transform(tokens(text), lambda t: F.when(t.rlike(r"^[-+]?\d+$"), t.try_cast("int"))), None)
    return F.struct(p["ok"].alias("ok"), F.array_distinct(p["values"]).alias("values"))


def parse_bools(text: Column, size: int | None = None) -> Column:
    """Only true, false, 1 and 0 count."""
    return _prefix(F.transform(tokens(text), lambda t: F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)), size)


def parse_pair(text: Column) -> Column:
    """One pair "a,b" as ``struct(ok, a, b)``; nulls where the text is anything else."""
    t = F.trim(text)
    ok = t.rlike(r"^\d+,\d+$")
    ab = F.split(t, ",")
    return F.struct(ok.alias("ok"), F.when(ok, ab[0].try_cast("long")).alias("a"), F.when(ok, F.try_element_at(ab, F.lit(2)).try_cast("long")).alias("b"))


def parse_pairs(text: Column) -> Column:
    """Tokens "a,b" packed as a * 2**32 + b."""

    def packed(t: Column) -> Column:
        ab = F.split(t, ",")
        return F.when(t.rlike(r"^\d+,\d+$"), F.shiftleft(ab[0].cast("long"), 32).bitwiseOR(ab[1].cast("long")))

    return _prefix(F.transform(tokens(text), packed), None)


def wrap_pi(x: Column) -> Column:
    """The angle in [-pi, pi)."""
    return x - F.floor(x / TAU + 0.5) * TAU


def wrap_2pi(x: Column) -> Column:
    return x - F.floor(x / TAU) * TAU


def relative_angle(a: Column, b: Column, full: bool = False) -> Column:
    return (wrap_2pi if full else wrap_pi)(b - a)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of longs, by as many Euclidean steps as the smaller one can need."""
    a, b = F.abs(a.cast("long")), F.abs(b.cast("long"))
    # Each two steps halve the smaller number at least by the golden ratio squared; the first may only swap.
    steps = F.ceil(F.log2(F.least(a, b).cast("double") + 1) * 1.4405).cast("int") + 3
    zero = F.lit(0).cast("long")
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.coalesce(F.try_mod(s["a"], s["b"]), zero).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), steps), F.struct(a.alias("a"), b.alias("b")), step, lambda s: s["a"])


# Stops of the default colour gradient (value, red, green, blue).
GRADIENT = [(0.0, 0, 0, 1), (0.25, 0, 1, 1), (0.5, 0, 1, 0), (0.75, 1, 1, 0), (1.0, 1, 0, 0)]


def color(value: Column, stops=GRADIENT) -> Column:
    """``struct(red, green, blue)``, linear between stops and constant beyond the outer ones."""
    stops = sorted(stops, key=lambda s: s[0])

    def channel(k: int) -> Column:
        out = F.lit(float(stops[-1][k]))
        for (v0, *c0), (v1, *c1) in reversed(list(zip(stops, stops[1:]))):
            at = (value - v0) / (v1 - v0) if v1 > v0 else F.lit(0.0)
            out = F.when(value < v1, float(c0[k - 1]) + at * float(c1[k - 1] - c0[k - 1])).otherwise(out)
        return F.when(value < stops[0][0], float(stops[0][k])).otherwise(out)

    return F.struct(channel(1).alias("red"), channel(2).alias("green"), channel(3).alias("blue"))


def bits(value: Column, bytes_: int = 4) -> Column:
    """Bits of an integer by byte in memory order (lowest first), highest bit first inside a byte."""
    one = lambda k: F.lpad(F.bin(F.shiftrightunsigned(value.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 8, "0")
    return F.concat_ws(" ", *(one(k) for k in range(bytes_)))


def progress(count: Column, interval: Column, length: int) -> Column:
    """Ticks of a progress bar; an interval of zero or less is a full one."""
    ticks = F.floor(F.try_divide(count.cast("double"), interval.cast("double"))) + 1
    return F.when(interval <= 0, F.lit(length).cast("long")).otherwise(F.least(ticks, F.lit(length).cast("long")))


def record_every(rate: Column, dt: Column) -> Column:
    """Steps between records for ``rate`` records a second."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.lit(1.0) / (rate * dt)))


def prox_half_line(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def prox_disk(x: Column, y: Column, radius) -> Column:
    """Nearest point of a disk about the origin."""
    d = F.sqrt(x * x + y * y)
    s = F.when(d > radius, F.try_divide(F.lit(1.0) * radius, d)).otherwise(1.0)
    return F.array(x * s, y * s)


def prox_box(v: Column, low, high) -> Column:
    return F.transform(v, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x)))


def prox_cone(n: Column, x: Column, y: Column, mu) -> Column:
    """Nearest point of the cone sqrt(x^2 + y^2) <= mu n."""
    t = F.sqrt(x * x + y * y)
    out_n = (n + mu * t) / (1 + mu * mu)
    s = F.try_divide(out_n * mu, t)
    return (
        F.when(t <= mu * n, F.array(n, x, y))
        .when(mu * t <= -n, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
        .otherwise(F.array(out_n, x * s, y * s))
    )


def gyro_term(kind: Column, h: Column, inertia: Column, omega: Column) -> Column:
    """Torque part of ``h`` (three components) less omega x (inertia omega); none for spheres."""
    from . import vectors as V

    spin = V.cross(omega, V.vec(*(i * w for i, w in zip(V.parts(inertia), V.parts(omega)))))
    return F.when(kind == "sphere", h).otherwise(V.vec(*(a - b for a, b in zip(V.parts(h), V.parts(spin)))))


def mass_diagonal(mass: Column, inertia: Column) -> Column:
    return F.concat(F.array(mass, mass, mass), inertia)


def inverse_diagonal(diagonal: Column) -> Column:
    """Element-wise inverse; null for a zero."""
    return F.transform(diagonal, lambda x: F.try_divide(F.lit(1.0), x))


def inertia_of(kind: Column, mass: Column, radius: Column, extent: Column) -> Column:
    """Principal moments of a solid sphere or box."""
    from . import vectors as V

    sphere = 0.4 * mass * radius * radius
    x2, y2, z2 = (p * p for p in V.parts(extent))
    return F.when(kind == "sphere", F.array(sphere, sphere, sphere)).when(
        kind == "box", V.vec(mass * (y2 + z2) / 12, mass * (x2 + z2) / 12, mass * (x2 + y2) / 12)
    )


def sphere_text(radius: Column) -> Column:
    """One line of a scene description language."""
    r = radius.cast("string")
    return F.concat(F.lit("Sphere "), r, F.lit(" -"), r, F.lit(" "), r, F.lit("  360\n"))


def geometry_text(kind: Column, radius: Column, extent: Column) -> Column:
    from . import vectors as V

    return (
        F.when(kind == "sphere", F.concat(F.lit("Sphere , radius: "), radius.cast("string")))
        .when(kind == "box", F.concat(F.lit("Box,  extent: "), V.to_text(extent, "\n")))
        .otherwise(F.raise_error(F.concat(F.lit("no description for geometry "), kind)))
    )


def centimetres_to_points(cm: Column) -> Column:
    return cm / 2.54 * 72


def enum_code(name: Column, names: list[str]) -> Column:
    """Number of an enum's value, from 0; another name fails the job."""
    found = F.array_position(F.array(*map(F.lit, names)), name) - 1
    return F.when(found >= 0, found).otherwise(F.raise_error(F.concat(F.lit("no such value: "), name)))


def task_text(name: Column, options: Column) -> Column:
    """One line for a task and its options (a map), by option name."""
    entries = F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(':"'), e["value"], F.lit('"')))
    return F.concat(F.lit(" Postprocess: "), name, F.lit(" : "), F.array_join(entries, ", "))


def uniform(low: float, high: float, seed: int) -> Column:
    return F.rand(seed) * (high - low) + low


def normal(mean: float, deviation: float, seed: int) -> Column:
    return F.randn(seed) * deviation + mean


def truncated_normal(mean: float, deviation: float, low: float, high: float, seed: int) -> Column:
    """Normal values within bounds, by the inverse distribution function of a uniform share of the mass between them."""
    standard = NormalDist()
    a, b = (low - mean) / deviation, (high - mean) / deviation
    mirrored = a > 0  # the far end of the upper tail has no digits left
    if mirrored:
        a, b = -b, -a
    p, q = standard.cdf(a), standard.cdf(b)

    @F.pandas_udf("double")
    def place(share: pd.Series) -> pd.Series:
        x = share.map(lambda u: standard.inv_cdf(min(max(p + u * (q - p), 5e-324), 1 - 2**-53))).clip(a, b)
        return ((-x if mirrored else x) * deviation + mean).clip(low, high)

    return place(F.rand(seed))


def palette(index: Column, colours: list[tuple[float, float, float]]) -> Column:
    """``struct(red, green, blue)`` of an 8-bit index; null beyond the palette."""
    entries = F.array(*(F.struct(F.lit(float(r)).alias("red"), F.lit(float(g)).alias("green"), F.lit(float(b)).alias("blue")) for r, g, b in colours))
    return F.get(entries, index.bitwiseAND(F.lit(255)).cast("int"))


def packed_depth(depth: Column) -> Column:
    """A depth in [0, 1) as three bytes, the highest first."""
    whole = F.floor(depth * F.lit(float(1 << 24))).cast("long")
    return F.array(*(F.shiftright(whole, s).bitwiseAND(F.lit(255)) for s in (16, 8, 0)))


def material_text(lines: Column) -> Column:
    """The lines of a material, each ended by a line feed."""
    return F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")


def prox_disk_scaled(n: Column, x: Column, y: Column, mu) -> Column:
    """Nearest point of the half line for ``n`` and, with radius mu times it, of the disk for (x, y)."""
    p = F.greatest(n, F.lit(0.0))
    d = prox_disk(x, y, p * mu)
    return F.array(p, d[0], d[1])


def prox_ellipsoid(v: Column, axes: Column, rounds: int = 60) -> Column:
    """Nearest point of the ellipsoid with half ``axes`` about the origin: v_i a_i^2 / (a_i^2 + t), t by bisection to the last digits.

    A zero axis leaves its component zero.
    """
    square = F.transform(axes, lambda a: a * a)
    inside = lambda t: F.aggregate(F.zip_with(v, axes, lambda x, a: F.coalesce(F.try_divide(x * a, a * a + t) * F.try_divide(x * a, a * a + t), F.when(x == 0, 0.0).otherwise(F.lit(float("inf"))))), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(F.zip_with(v, axes, lambda x, a: x * a * x * a), F.lit(0.0), lambda s, x: s + x))
    narrow = lambda s, _: F.struct(F.when(inside((s["low"] + s["high"]) / 2) > 1, (s["low"] + s["high"]) / 2).otherwise(s["low"]).alias("low"), F.when(inside((s["low"] + s["high"]) / 2) > 1, s["high"]).otherwise((s["low"] + s["high"]) / 2).alias("high"))
    t = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.lit(0.0).alias("low"), norm.alias("high")), narrow, lambda s: s["high"])
    outside = F.zip_with(v, square, lambda x, a2: F.coalesce(F.try_divide(x * a2, a2 + t), F.lit(0.0)))
    return F.when(F.coalesce(inside(F.lit(0.0)) <= 1, F.lit(False)), v).otherwise(outside)


def prox_half_line_ellipsoid(n: Column, v: Column, axes: Column) -> Column:
    """Nearest point of the half line for ``n``, and for ``v`` of the ellipsoid whose half axes are ``axes`` times it."""
    p = F.greatest(n, F.lit(0.0))
    return F.concat(F.array(p), prox_ellipsoid(v, F.transform(axes, lambda a: a * p)))


def rounded(x: Column, digits: int = 6) -> Column:
    """F.round of a double; by arithmetic, unless the number is large or lies by the middle of two results. Give it a column, as it stands in several places."""
    scaled = x * 10.0**digits
    whole = F.floor(scaled + 0.5)
    sure = (F.abs(scaled) < 1e9) & (F.abs(scaled - whole) < 0.4999)
    return F.when(sure, whole / F.lit(10.0**digits)).otherwise(F.round(x, digits))

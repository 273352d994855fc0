"""Vector, matrix and quaternion algebra as column expressions.

Vectors of three or four components are unrolled, which keeps them inside whole-stage code generation; vectors of any
length use higher-order functions. Quaternions are (x, y, z, w). Matrices are arrays of rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(*parts) -> Column:
    return F.array(*(p if isinstance(p, Column) else F.lit(float(p)) for p in parts))


def parts(v: Column, n: int = 3) -> list[Column]:
    return [v[i] for i in range(n)]


def dot(a: Column, b: Column) -> Column:
    """Inner product of vectors of any one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot3(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def component(v: Column, index) -> Column:
    """Component by an index from 0; one out of range raises (under ANSI mode)."""
    return F.element_at(v, (index if isinstance(index, Column) else F.lit(index)) + 1)


# Inside this module vectors are lists of scalar columns: indexing an array expression repeats all its parts.
def _add(a: list, b: list) -> list:
    return [x + y for x, y in zip(a, b)]


def _scaled(v: list, s) -> list:
    return [x * s for x in v]


def _cross(a: list, b: list) -> list:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _rotate(q: list, v: list) -> list:
    inner = _add(_cross(q, v), _scaled(v, q[3]))
    return _add(v, _scaled(_cross(q, inner), 2.0))


def add(a: Column, b: Column) -> Column:
    return vec(*_add(parts(a), parts(b)))


def scaled(v: Column, s) -> Column:
    return vec(*_scaled(parts(v), s))


def cross(a: Column, b: Column) -> Column:
    return vec(*_cross(parts(a), parts(b)))


def rotate(q: Column, v: Column) -> Column:
    """``v`` turned by the unit quaternion ``q``: v + 2 u x (u x v + w v), u the vector part."""
    return vec(*_rotate(parts(q, 4), parts(v)))


def transform(q: Column, t: Column, v: Column) -> Column:
    return vec(*_add(_rotate(parts(q, 4), parts(v)), parts(t)))


def quaternion(axis: Column, angle: Column) -> Column:
    """Unit quaternion about ``axis`` (any length but zero, which gives null)."""
    length = F.sqrt(dot3(axis, axis))
    s = F.try_divide(F.sin(angle / 2), length)
    return F.when(length > 0, vec(axis[0] * s, axis[1] * s, axis[2] * s, F.cos(angle / 2)))


def quaternion_product(a: Column, b: Column) -> Column:
    (ax, ay, az, aw), (bx, by, bz, bw) = parts(a, 4), parts(b, 4)
    return vec(
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
        aw * bw - ax * bx - ay * by - az * bz,
    )


def quaternion_of(matrix: Column) -> Column:
    """Quaternion of a rotation matrix with a trace above -1."""
    m = [[matrix[i][j] for j in range(3)] for i in range(3)]
    w = F.sqrt(F.greatest(F.lit(0.0), 1.0 + m[0][0] + m[1][1] + m[2][2])) / 2
    k = F.try_divide(F.lit(0.25), w)
    return vec((m[2][1] - m[1][2]) * k, (m[0][2] - m[2][0]) * k, (m[1][0] - m[0][1]) * k, w)


def skew(v: Column, diagonal: Column | None = None) -> Column:
    """The matrix S with S b = v x b; a given ``diagonal`` is kept in place of zeros."""
    x, y, z = parts(v)
    d = parts(diagonal) if diagonal is not None else [F.lit(0.0)] * 3
    return F.array(vec(d[0], -z, y), vec(z, d[1], -x), vec(-y, x, d[2]))


def symmetric(v: Column) -> Column:
    """3 x 3 matrix from its entries 00, 01, 02, 11, 12, 22."""
    a, b, c, d, e, f = parts(v, 6)
    return F.array(vec(a, b, c), vec(b, d, e), vec(c, e, f))


def homogeneous(q: Column, t: Column) -> Column:
    """4 x 4 matrix of a rotation and a translation."""
    unit = lambda i: [F.lit(1.0 if i == j else 0.0) for j in range(3)]
    columns = [_rotate(parts(q, 4), unit(i)) for i in range(3)]
    return F.array(*(vec(columns[0][i], columns[1][i], columns[2][i], t[i]) for i in range(3)), vec(0, 0, 0, 1))


def basis(v: Column) -> Column:
    """Three orthonormal vectors, the first along ``v``; the second has no y where the first has more of x than of z, else no x, and the third is their product."""
    length = F.sqrt(dot3(v, v))
    e = [p / length for p in parts(v)]
    x, y, z = e
    in_xz, in_yz = F.sqrt(x * x + z * z), F.sqrt(y * y + z * z)
    flat = F.abs(x) > F.abs(z)
    second = [F.when(flat, a).otherwise(b) for a, b in ((-z / in_xz, F.lit(0.0)), (F.lit(0.0), z / in_yz), (x / in_xz, -y / in_yz))]
    return F.when(length > 0, F.array(vec(*e), vec(*second), vec(*_cross(e, second))))


def upright(matrix: Column) -> Column:
    """The columns of a rotation matrix turned in a cycle: the first one comes last if the first row has the largest last entry, the second one if the second row has it."""
    x, y, z = (matrix[i][2] for i in range(3))
    turned = lambda i, j, k: F.transform(matrix, lambda row: F.array(row[i], row[j], row[k]))
    return F.when((x > y) & (x > z), turned(1, 2, 0)).when((y > x) & (y > z), turned(2, 0, 1)).otherwise(matrix)


def is_finite(v: Column) -> Column:
    return F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def is_orthogonal(axes: Column, eps: float = 1e-6, signed: bool = False) -> Column:
    """No two of three axes have an inner product beyond ``eps``; with ``signed`` only products above it count."""
    a, b, c = axes[0], axes[1], axes[2]
    size = (lambda x: x) if signed else F.abs
    return (size(dot3(a, b)) <= eps) & (size(dot3(b, c)) <= eps) & (size(dot3(a, c)) <= eps)


def is_contact_frame(axes: Column) -> Column:
    """Whether the second of three axes is orthogonal to either other, to within 1e-3; the pair of first and third isn't asked."""
    a, b, c = axes[0], axes[1], axes[2]
    return (F.abs(dot3(a, b)) < 1e-3) & (F.abs(dot3(b, c)) < 1e-3)


def clamp(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, v))


def box_corners(extent: Column) -> Column:
    """The eight corners of a box about the origin; corner i takes the lower side of axis k where bit k of i is set."""
    return F.array(*(vec(*(extent[k] * (-0.5 if i >> k & 1 else 0.5) for k in range(3))) for i in range(8)))


def ray_point(origin: Column, direction: Column, t: Column) -> Column:
    """Point at distance ``t`` along a direction of any length."""
    length = F.sqrt(dot3(direction, direction))
    return vec(*(o + d / length * t for o, d in zip(parts(origin), parts(direction))))


def to_text(v: Column, separator: str = " ") -> Column:
    return F.array_join(F.transform(v, lambda x: x.cast("string")), separator)


def matrix_text(rows: Column, style: str = "space") -> Column:
    """Rows of numbers as text in full precision: ``space`` and ``comma`` a row a line, ``matlab`` in brackets, with columns of one width."""
    if style in ("space", "comma"):
        return F.array_join(F.transform(rows, lambda r: to_text(r, {"space": " ", "comma": ", "}[style])), "\n")
    if style != "matlab":
        raise ValueError(f"no style {style}")
    texts = F.transform(rows, lambda r: F.transform(r, lambda x: x.cast("string")))
    width = F.array_max(F.transform(F.flatten(texts), lambda x: F.length(x)))
    padded = F.transform(texts, lambda r: F.array_join(F.transform(r, lambda x: F.lpad(x, width, F.lit(" "))), ", "))
    return F.concat(F.lit("["), F.array_join(padded, ";\n "), F.lit("]"))

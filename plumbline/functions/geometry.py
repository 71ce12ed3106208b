"""Rigid geometry as column expressions: vectors are 3 columns, matrices 9 in row order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = Sequence[Column]
Mat = Sequence[Column]


def bound(values: Sequence[Column], out: Callable[[list[Column]], list[Column]]) -> Column:
    """``out(values)`` as an array, each value computed once under a name of its own. Expressions
    built on expressions would otherwise grow with every level; give named columns."""
    rows = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.get(F.transform(rows, lambda x: F.array(*out([x[f"v{i}"] for i in range(len(values))]))), F.lit(0))


def then(array: Column, n: int, out: Callable[[list[Column]], list[Column]]) -> Column:
    """``out`` of an array's n items, the array computed once."""
    return F.get(F.transform(F.array(array), lambda a: F.array(*out([F.get(a, F.lit(i)) for i in range(n)]))), F.lit(0))


def _items(array: Column, n: int) -> list[Column]:
    return [F.get(array, F.lit(i)) for i in range(n)]


def computed(rows: DataFrame, keep: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """``rows`` with the kept and the new columns, which come from a generator: filters and later
    expressions refer to them by name, where a projection's would be written out in them again."""
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def vec(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def constant(values: Sequence[float]) -> list[Column]:
    return [F.lit(float(v)) for v in values]


def items(array: str, n: int) -> list[Column]:
    return [F.get(array, F.lit(i)) for i in range(n)]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Vec, b: Vec) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def distance(a: Vec, b: Vec) -> Column:
    return norm(minus(a, b))


def spherical(p: Vec) -> tuple[Column, Column, Column]:
    """(range, azimuth, elevation) in radians; all 0 at the origin."""
    r = norm(p)
    near = r < 1e-9
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), p[2] / F.when(near, 1.0).otherwise(r)))
    return F.when(near, 0.0).otherwise(r), F.when(near, 0.0).otherwise(F.atan2(p[1], p[0])), F.when(near, 0.0).otherwise(F.asin(sine))


def wrap(angle: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(angle + F.pi(), 2 * F.pi()) - F.pi()


def range_corrected(p: Vec, scale: float, bias: float) -> list[Column]:
    """Moves a point along its ray to range scale * r - bias; as it is if that changes nothing."""
    if scale == 1 and bias == 0:
        return list(p)
    scaled = [c * scale for c in p]
    r = F.greatest(norm(scaled), F.lit(1e-6))
    return [c * ((r - bias) / r) for c in scaled]


def turned(m: Mat, p: Vec) -> list[Column]:
    return [dot(m[3 * i : 3 * i + 3], p) for i in range(3)]


def transposed(m: Mat) -> list[Column]:
    return [m[3 * j + i] for i in range(3) for j in range(3)]


def rigid(m: Mat, t: Vec, p: Vec) -> list[Column]:
    """R p + t."""
    return [a + b for a, b in zip(turned(m, p), t, strict=True)]


def rigid_inverse(m: Mat, t: Vec, p: Vec) -> list[Column]:
    """R' (p - t)."""
    return turned(transposed(m), minus(p, t))


def multiplied(a: Mat, b: Mat) -> list[Column]:
    return [sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)]


def composed(a: Mat, ta: Vec, b: Mat, tb: Vec) -> tuple[list[Column], list[Column]]:
    """First (b, tb), then (a, ta)."""
    return multiplied(a, b), rigid(a, ta, tb)


def inverted(m: Mat, t: Vec) -> tuple[list[Column], list[Column]]:
    back = transposed(m)
    return back, [-c for c in turned(back, t)]


def with_pixels(rows: DataFrame, p: Vec, k: Mat, d: Vec) -> DataFrame:
    """``rows`` ahead of the camera (p[2] > 0) with whole pixels u and v as ``projected`` gives them.

    In steps of named columns, which stay apart as each is used several times; the pixels come
    from a generator, below which no filter on them is pushed, so nothing is computed twice.
    """
    rows = rows.withColumns({"x_": p[0] / p[2], "y_": p[1] / p[2]})
    x, y, r2 = F.col("x_"), F.col("y_"), F.col("r2_")
    rows = rows.withColumn("r2_", x * x + y * y)
    rows = rows.withColumn("radial_", 1 + d[0] * r2 + d[1] * r2 * r2 + d[4] * r2 * r2 * r2)
    xd = x * F.col("radial_") + 2 * d[2] * x * y + d[3] * (r2 + 2 * x * x)
    yd = y * F.col("radial_") + d[2] * (r2 + 2 * y * y) + 2 * d[3] * x * y
    pixel = {"u": F.rint(k[0] * xd + k[2]).try_cast("long"), "v": F.rint(k[4] * yd + k[5]).try_cast("long")}
    return computed(rows, ["*"], pixel).drop("x_", "y_", "r2_", "radial_")


def projected(p: Vec, k: Mat, d: Vec) -> tuple[Column, Column]:
    """Whole pixels (half to even) of a pinhole camera with k1 k2 p1 p2 k3 distortion; null behind it or beyond all numbers."""
    ahead = p[2] > 0
    z = F.when(ahead, p[2])
    x, y = p[0] / z, p[1] / z
    r2 = x * x + y * y
    radial = 1 + d[0] * r2 + d[1] * r2 * r2 + d[4] * r2 * r2 * r2
    xd = x * radial + 2 * d[2] * x * y + d[3] * (r2 + 2 * x * x)
    yd = y * radial + d[2] * (r2 + 2 * y * y) + 2 * d[3] * x * y
    return F.rint(k[0] * xd + k[2]).try_cast("long"), F.rint(k[4] * yd + k[5]).try_cast("long")


def quaternion_product(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    """The turn b, then a; x, y, z, w."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return [aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz]


def conjugate(q: Sequence[Column]) -> list[Column]:
    """The turn back."""
    return [-q[0], -q[1], -q[2], q[3]]


def cross(a: Vec, b: Vec) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def turned_by(q: Sequence[Column], p: Vec) -> list[Column]:
    """A point turned by a unit quaternion: p + 2 w (v x p) + 2 v x (v x p)."""
    side = cross(q[:3], p)
    return [x + 2 * (q[3] * s + u) for x, s, u in zip(p, side, cross(q[:3], side), strict=True)]


def matrix_of_quaternion(q: Sequence[Column]) -> list[Column]:
    """Of a unit quaternion x, y, z, w."""
    x, y, z, w = q
    one, two = F.lit(1.0), F.lit(2.0)
    return [
        one - two * (y * y + z * z), two * (x * y - z * w), two * (x * z + y * w),
        two * (x * y + z * w), one - two * (x * x + z * z), two * (y * z - x * w),
        two * (x * z - y * w), two * (y * z + x * w), one - two * (x * x + y * y),
    ]


def quaternion_of_matrix(m: Mat) -> list[Column]:
    """x, y, z, w with w >= 0. The largest component is found first, so nothing small divides."""
    return _items(_quaternion(m), 4)


def _quaternion(m: Mat) -> Column:
    return then(bound(m, _unsigned), 4, lambda q: [c * F.when(q[3] < 0, -1.0).otherwise(1.0) for c in q])


def _unsigned(m: Mat) -> list[Column]:
    squares = [1 + m[0] - m[4] - m[8], 1 - m[0] + m[4] - m[8], 1 - m[0] - m[4] + m[8], 1 + m[0] + m[4] + m[8]]  # 4 x^2, ...
    pairs = {(0, 1): m[1] + m[3], (0, 2): m[2] + m[6], (1, 2): m[5] + m[7], (0, 3): m[7] - m[5], (1, 3): m[2] - m[6], (2, 3): m[3] - m[1]}  # 4 x y, ...
    top = F.greatest(*squares)
    scale = 2 * F.sqrt(top)
    out = []
    for j in range(4):
        by_largest = F.lit(0.0)
        for i in range(4):
            value = squares[i] if i == j else pairs[min(i, j), max(i, j)]
            by_largest = F.when(squares[i] >= top, value / scale).otherwise(by_largest)
        out.append(by_largest)
    return out


def matrix_of_rotvec(v: Vec) -> list[Column]:
    """Rodrigues' formula; series near no rotation."""
    return _items(bound([*v, norm(v)], _rodrigues), 9)


def _rodrigues(v: Sequence[Column]) -> list[Column]:
    x, y, z, angle = v
    small = angle < 1e-8
    safe = F.when(small, 1.0).otherwise(angle)
    a = F.when(small, 1.0).otherwise(F.sin(safe) / safe)
    b = F.when(small, 0.5).otherwise((1 - F.cos(safe)) / (safe * safe))
    c = 1 - b * angle * angle
    return [c + b * x * x, b * x * y - a * z, b * x * z + a * y, b * x * y + a * z, c + b * y * y, b * y * z - a * x, b * x * z - a * y, b * y * z + a * x, c + b * z * z]


def rotvec_of_matrix(m: Mat) -> list[Column]:
    """Axis times angle, angle in [0, pi]."""
    return _items(then(_quaternion(m), 4, _axis_angle), 3)


def _axis_angle(q: Sequence[Column]) -> list[Column]:
    length = norm(q[:3])
    small = length < 1e-12
    factor = F.when(small, 2.0).otherwise(2 * F.atan2(length, q[3]) / F.when(small, 1.0).otherwise(length))
    return [c * factor for c in q[:3]]


def matrix_of_euler(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    """Turns about the fixed x, then y, then z axis, in radians."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, -sp, cp * sr, cp * cr]


def euler_of_matrix(m: Mat) -> tuple[Column, Column, Column]:
    """Roll, pitch, yaw; at a pitch of 90 degrees only their combination is defined."""
    return F.atan2(m[7], m[8]), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -m[6]))), F.atan2(m[3], m[0])


def sigma_residual(measured: Vec, expected: Vec, sigma_r: float, sigma_az: float, sigma_el: float | None) -> tuple[list[Column], Column]:
    """Differences of range and wrapped angles over their sigmas, and their root mean square."""
    a, b = spherical(measured), spherical(expected)
    out = [(a[0] - b[0]) / sigma_r, wrap(a[1] - b[1]) / sigma_az]
    if sigma_el is not None:
        out.append(wrap(a[2] - b[2]) / sigma_el)
    return out, F.sqrt(sum((c * c for c in out[1:]), out[0] * out[0]) / len(out))

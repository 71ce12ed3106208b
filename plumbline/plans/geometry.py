"""Queries of single expressions: projections of points, poses and rotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators.gating import predicted, xyz
from plumbline.plans import common as c
from plumbline.sources import tables as s

KEY = ["frame_id", "k1", "k2", "k3", "k4"]
_RANGE = "sqrt(x * x + y * y + z * z)"
_PI2 = "(2 * pi())"


def _named(columns, names):
    return [c.rounded(x).alias(n) for x, n in zip(columns, names, strict=True)]


def scan_points(spark, d):
    return c.rounded_all(s.points(spark, d), KEY)


def optional_fields(spark, d):
    """A cloud without snr and doppler."""
    raw = s.points(spark, d).drop("snr", "doppler")
    return c.rounded_all(s.scanned_points(raw, keep=tuple(KEY)), KEY)


def range_azimuth_elevation(spark, d):
    return s.points(spark, d).select(*KEY, *_named(g.spherical(xyz()), ("r", "az", "el")))


def wrap_angle(spark, d):
    return s.table(spark, d, "events").select("event_id", c.rounded(g.wrap(F.col("value") - 20)).alias("angle"))


def range_correct(spark, d):
    return s.points(spark, d).select(*KEY, *_named(g.range_corrected(xyz(), 1.02, 0.03), "xyz"))


def sigma_residual(spark, d):
    rows = s.points(spark, d).join(s.camera(spark, d), "frame_id")
    parts, rms = g.sigma_residual(xyz(), predicted(), 0.05, 0.05, 0.2)
    return rows.select(*KEY, *_named([*parts, rms], ("e_r", "e_az", "e_el", "e_rms")))


def rigid_apply(spark, d):
    return s.points(spark, d).select(*KEY, *_named(g.rigid(g.constant(c.R), g.constant(c.T), xyz()), "xyz"))


def rigid_inverse(spark, d):
    """The camera's points as the sensor has them."""
    r, t = g.constant(c.R), g.constant(c.T)
    return s.points(spark, d).select(*KEY, *_named(g.rigid_inverse(r, t, xyz()), "xyz"))


def compose_pose(spark, d):
    """A pose after the fixed one, and its inverse's translation."""
    r, t = g.constant(c.R), g.constant(c.T)
    turn = g.matrix_of_euler(F.lit(0.0), F.lit(0.0), F.radians(F.col("o_custkey") % 121 - 60))
    rows = s.table(spark, d, "orders").join(s.camera(spark, d).withColumnRenamed("frame_id", "o_orderkey"), "o_orderkey")
    m, v = g.composed(r, t, turn, predicted())
    _, back = g.inverted(m, v)
    return rows.select("o_orderkey", *_named([m[0], m[4], m[8], *v, *back], ("m00", "m11", "m22", "x", "y", "z", "bx", "by_", "bz")))


def project_pixels(spark, d):
    u, v = g.projected([F.col("y"), F.col("z"), F.col("x") - 0.5], g.constant(c.K), g.constant(c.D))
    return s.points(spark, d).select(*KEY, u.alias("u"), v.alias("v"))


_QUAT = "q AS (SELECT c_custkey, (c_custkey % 17 - 8)::DOUBLE AS a, (c_nationkey - 12)::DOUBLE AS b, (c_custkey % 7 - 3)::DOUBLE AS c, (c_custkey % 5 - 2.25)::DOUBLE AS d FROM customer), n AS (SELECT c_custkey, a / s AS x, b / s AS y, c / s AS z, d / s AS w FROM (SELECT *, sqrt(a * a + b * b + c * c + d * d) AS s FROM q))"


def quat_matrix(spark, d):
    k = F.col("c_custkey")
    raw = [x.cast("double") for x in (k % 17 - 8, F.col("c_nationkey") - 12, k % 7 - 3, k % 5 - 2.25)]
    size = F.sqrt(sum((x * x for x in raw[1:]), raw[0] * raw[0]))
    return _there_and_back(s.table(spark, d, "customer"), g.matrix_of_quaternion([x / size for x in raw]), g.quaternion_of_matrix, ["x", "y", "z", "w"])


def _there_and_back(rows, m, back, names):
    """The matrix, and what it was made of."""
    m_names = [f"m{i}" for i in range(9)]
    rows = rows.select("c_custkey", *[x.alias(n) for x, n in zip(m, m_names, strict=True)])
    return rows.select("c_custkey", *_named([*g.vec(*m_names), *back(g.vec(*m_names))], m_names + names))


def rotvec_matrix(spark, d):
    k = F.col("c_custkey")
    v = [(x / 10).cast("double") for x in (k % 13 - 6, k % 11 - 5, k % 23 - 11)]
    return _there_and_back(s.table(spark, d, "customer"), g.matrix_of_rotvec(v), g.rotvec_of_matrix, ["x", "y", "z"])


def euler_matrix(spark, d):
    k = F.col("c_custkey")
    angles = [F.radians((x * 1.0).cast("double")) for x in (k % 351 - 175, k % 171 - 85, k % 337 - 168)]
    return _there_and_back(s.table(spark, d, "customer"), g.matrix_of_euler(*angles), lambda m: [F.degrees(x) for x in g.euler_of_matrix(m)], ["roll", "pitch", "yaw"])


def board_corner_grid(spark, d):
    return c.rounded_all(s.board_corners(spark, 9, 7, 0.02), ["corner_id"])


QUERIES = {f.__name__: f for f in (scan_points, optional_fields, range_azimuth_elevation, wrap_angle, range_correct, sigma_residual, rigid_apply, rigid_inverse, compose_pose, project_pixels, quat_matrix, rotvec_matrix, euler_matrix, board_corner_grid)}

_K = ", ".join(KEY)


def _pts(select: str, frm: str = "points", more: str = "") -> str:
    return f"WITH {c.POINTS}{more} SELECT {_K}, {select} FROM {frm}"


def _xyz(parts) -> str:
    return ", ".join(f"{c.r(p)} AS {n}" for p, n in zip(parts, "xyz", strict=True))


def _wrapped(a: str) -> str:
    return f"((({a}) + pi()) - {_PI2} * floor((({a}) + pi()) / {_PI2}) - pi())"


_BEHIND = "z1 <= 0"
ORACLES = {
    "scan_points": _pts(", ".join(f"{c.r(x)} AS {x}" for x in ("x", "y", "z", "snr", "doppler"))),
    "optional_fields": _pts(_xyz("xyz") + ", 0.0::DOUBLE AS snr, 0.0::DOUBLE AS doppler"),
    "range_azimuth_elevation": _pts(f"{c.r(_RANGE)} AS r, {c.r('atan2(y, x)')} AS az, {c.r(f'asin(greatest(-1, least(1, z / {_RANGE})))')} AS el"),
    "wrap_angle": f"SELECT event_id, {c.r(_wrapped('value - 20'))} AS angle FROM events",
    "range_correct": _pts(_xyz([f"({v} * 1.02) * ((1.02 * {_RANGE} - 0.03) / (1.02 * {_RANGE}))" for v in "xyz"])),
    "sigma_residual": f"""WITH {c.POINTS}, {c.CAMERA}, e AS (
        SELECT {_K}, ({_RANGE} - cam_range) / 0.05 AS a, {_wrapped('atan2(y, x) - atan2(py, px)')} / 0.05 AS b,
               {_wrapped(f'asin(greatest(-1, least(1, z / {_RANGE})))')} / 0.2 AS c FROM points JOIN camera USING (frame_id))
        SELECT {_K}, {c.r('a')} AS e_r, {c.r('b')} AS e_az, {c.r('c')} AS e_el, {c.r('sqrt((a * a + b * b + c * c) / 3)')} AS e_rms FROM e""",
    "rigid_apply": _pts(_xyz(c.rigid_sql(c.R, c.T, ["x", "y", "z"]))),
    "rigid_inverse": _pts(_xyz([" + ".join(f"({c.R[3 * j + i]}::DOUBLE) * ({a} - ({c.T[j]}::DOUBLE))" for j, a in enumerate("xyz")) for i in range(3)])),
    "compose_pose": f"""WITH {c.CAMERA}, o AS (
        SELECT o_orderkey, cos(radians(o_custkey % 121 - 60)) AS co, sin(radians(o_custkey % 121 - 60)) AS si, px, py, pz
        FROM orders JOIN camera ON frame_id = o_orderkey),
        m AS (SELECT o_orderkey, 0.36 * co + 0.48 * si AS m00, -0.8 * co + 0.6 * si AS m10, 0.48 * co + 0.64 * si AS m20,
                     -0.36 * si + 0.48 * co AS m01, 0.8 * si + 0.6 * co AS m11, -0.48 * si + 0.64 * co AS m21,
                     {', '.join(f'{e} AS {n}' for e, n in zip(c.rigid_sql(c.R, c.T, ['px', 'py', 'pz']), 'xyz', strict=True))} FROM o)
        SELECT o_orderkey, {c.r('m00')} AS m00, {c.r('m11')} AS m11, 0.6::DOUBLE AS m22, {c.r('x')} AS x, {c.r('y')} AS y, {c.r('z')} AS z,
               {c.r('-(m00 * x + m10 * y + m20 * z)')} AS bx, {c.r('-(m01 * x + m11 * y + m21 * z)')} AS by_, {c.r('-(-0.8 * x + 0.6 * z)')} AS bz FROM m""",
    "project_pixels": f"""WITH {c.POINTS}, n AS (
        SELECT {_K}, CASE WHEN x - 0.5 > 0 THEN y / (x - 0.5) END AS a, CASE WHEN x - 0.5 > 0 THEN z / (x - 0.5) END AS b FROM points),
        q AS (SELECT *, a * a + b * b AS r2 FROM n),
        w AS (SELECT *, 1 + 0.1 * r2 - 0.05 * r2 * r2 + 0.01 * r2 * r2 * r2 AS s FROM q)
        SELECT {_K}, TRY_CAST(round_even(500 * (a * s + 0.002 * a * b - 0.002 * (r2 + 2 * a * a)) + 480, 0) AS BIGINT) AS u,
               TRY_CAST(round_even(510 * (b * s + 0.001 * (r2 + 2 * b * b) - 0.004 * a * b) + 270, 0) AS BIGINT) AS v FROM w""",
    "quat_matrix": f"""WITH {_QUAT} SELECT c_custkey, {c.r('1 - 2 * (y * y + z * z)')} AS m0, {c.r('2 * (x * y - z * w)')} AS m1, {c.r('2 * (x * z + y * w)')} AS m2,
        {c.r('2 * (x * y + z * w)')} AS m3, {c.r('1 - 2 * (x * x + z * z)')} AS m4, {c.r('2 * (y * z - x * w)')} AS m5,
        {c.r('2 * (x * z - y * w)')} AS m6, {c.r('2 * (y * z + x * w)')} AS m7, {c.r('1 - 2 * (x * x + y * y)')} AS m8,
        {', '.join(f"{c.r(f'{v} * sign(w)')} AS {v}" for v in 'xyzw')} FROM n""",
    "rotvec_matrix": f"""WITH v AS (SELECT c_custkey, (c_custkey % 13 - 6) / 10 AS x, (c_custkey % 11 - 5) / 10 AS y, (c_custkey % 23 - 11) / 10 AS z FROM customer),
        a AS (SELECT *, sqrt(x * x + y * y + z * z) AS t FROM v),
        f AS (SELECT *, CASE WHEN t < 1e-8 THEN 1 ELSE sin(t) / t END AS s, CASE WHEN t < 1e-8 THEN 0.5 ELSE (1 - cos(t)) / (t * t) END AS b, cos(t) AS o FROM a)
        SELECT c_custkey, {c.r('o + b * x * x')} AS m0, {c.r('b * x * y - s * z')} AS m1, {c.r('b * x * z + s * y')} AS m2,
               {c.r('b * x * y + s * z')} AS m3, {c.r('o + b * y * y')} AS m4, {c.r('b * y * z - s * x')} AS m5,
               {c.r('b * x * z - s * y')} AS m6, {c.r('b * y * z + s * x')} AS m7, {c.r('o + b * z * z')} AS m8, {_xyz('xyz')} FROM f""",
    "euler_matrix": f"""WITH v AS (SELECT c_custkey, c_custkey % 351 - 175 AS r0, c_custkey % 171 - 85 AS p0, c_custkey % 337 - 168 AS y0 FROM customer),
        t AS (SELECT *, cos(radians(r0)) AS cr, sin(radians(r0)) AS sr, cos(radians(p0)) AS cp, sin(radians(p0)) AS sp, cos(radians(y0)) AS cy, sin(radians(y0)) AS sy FROM v)
        SELECT c_custkey, {c.r('cy * cp')} AS m0, {c.r('cy * sp * sr - sy * cr')} AS m1, {c.r('cy * sp * cr + sy * sr')} AS m2,
               {c.r('sy * cp')} AS m3, {c.r('sy * sp * sr + cy * cr')} AS m4, {c.r('sy * sp * cr - cy * sr')} AS m5,
               {c.r('-sp')} AS m6, {c.r('cp * sr')} AS m7, {c.r('cp * cr')} AS m8, r0::DOUBLE AS roll, p0::DOUBLE AS pitch, y0::DOUBLE AS yaw FROM t""",
    "board_corner_grid": f"SELECT i::INTEGER AS corner_id, {c.r('(i % 8) * 0.02::DOUBLE')} AS x, {c.r('(i // 8) * 0.02::DOUBLE')} AS y, 0.0::DOUBLE AS z FROM range(48) t(i)",
}

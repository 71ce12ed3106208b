"""Queries of the frame tree, and of packed clouds and recordings of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators import frames as fr
from plumbline.operators.gating import range_gate
from plumbline.plans import common as c
from plumbline.sources import clouds
from plumbline.sources import tables as s
from plumbline.sources.recording import recorded, register
from plumbline.storage import new_folder, written
from plumbline.streaming.replay import settings

# ---- the frame tree -----------------------------------------------------------------------------


def _edges(spark, d):
    """orders as edges that their customers' frames are told by; the newest of a customer holds. Chains of
    eight frames hang on the frame of an eighth of their number, or on one of seven other trees."""
    k, i = F.col("o_custkey"), F.col("o_orderkey")
    parent = F.when(i % 11 == 0, 1_000_000 + k % 7).when(k % 8 == 0, F.floor(k / 8)).otherwise(k - 1)
    a, b, e = ((x / 40).cast("double") for x in (i % 7 - 3, i % 5 - 2, i % 3 - 1))
    size = 1 / F.sqrt(1 + a * a + b * b + e * e)
    pose = {"tx": i % 11 / 97 * c.UNIT, "ty": (i % 13 / 101 - 0.05) * c.UNIT, "tz": i % 17 / 193 * c.UNIT, "qx": a * size, "qy": b * size, "qz": e * size, "qw": size}
    return s.table(spark, d, "orders").select(k.alias("child"), parent.cast("long").alias("parent"), i.alias("stamp"), *[x.alias(n) for n, x in pose.items()])


def frame_roots(spark, d):
    """Every frame's place in the root of its tree."""
    rows = fr.in_roots(_edges(spark, d))
    sign = F.when(F.col("qw") < 0, -1.0).otherwise(1.0)
    return c.rounded_all(rows.select("frame", "root", *fr.T, *[(F.col(n) * sign).alias(n) for n in fr.Q]), [])


def frame_lookup(spark, d):
    """The newest pose of each customer's frame in another's, and its inverse's translation."""
    k = F.col("c_custkey")
    pairs = s.table(spark, d, "customer").select(k.alias("source"), (k * 7 % 1000 + 1).alias("target"))
    found = fr.looked_up(pairs, fr.in_roots(_edges(spark, d)))
    back = [-x for x in g.turned_by(g.conjugate([F.col(n) for n in fr.Q]), [F.col(n) for n in fr.T])]
    return c.rounded_all(found.withColumns(dict(zip(("bx", "by_", "bz"), back, strict=True))), [])


# ---- packed clouds ------------------------------------------------------------------------------

KEY = s.POINT_KEY
#: Layouts of messages: little-endian with unwanted fields between, and big-endian with doubles first and padded points.
LAYOUTS = [
    ({"x": "f8", "noise": "u2", "y": "f8", "z": "f8", "intensity": "f8", "doppler": "f8", "k1": "i4", "k2": "i4", "k3": "u4", "k4": "f8"}, False, None, None),
    ({"doppler": "f8", "k4": "f8", "k3": "i4", "k2": "u4", "k1": "u1", "intensity": "f8", "z": "f8", "y": "f8", "x": "f8"}, True, 80, 2),
]
FIELDS = {"x": "x", "y": "y", "z": "z", "snr": "intensity", "doppler": "doppler"} | {k: k for k in KEY}


def _messages(spark, d):
    """lineitem's points as packed messages, a frame each; odd frames in the second layout."""
    rows = s.points(spark, d).withColumn("noise", F.lit(7)).withColumnRenamed("snr", "intensity")
    point = F.struct("x", "y", "z", "intensity", "doppler", "noise", *KEY)
    frames = rows.groupBy("frame_id").agg(F.array_sort(F.collect_list(point)).alias("points"))
    frames = frames.withColumn("stamp_us", F.lit(1_600_000_000_000_000) + F.col("frame_id") * 100_000)
    parts = [clouds.packed(frames.where(F.col("frame_id") % 2 == k), *layout) for k, layout in enumerate(LAYOUTS)]
    return parts[0].unionByName(parts[1])


def _scanned(rows):
    return rows.select("frame_id", *[F.col(k).cast("double").alias(k) for k in KEY], *[c.rounded(n).alias(n) for n in ("x", "y", "z", "snr", "doppler")])


def packed_scan(spark, d):
    """Points read out of packed messages, in both byte orders."""
    return _scanned(clouds.decoded(_messages(spark, d), FIELDS))


def packed_select(spark, d):
    """Only x and y, of the messages' ten fields, with each point's place in its cloud."""
    rows = clouds.decoded(_messages(spark, d), {"x": "x", "y": "y", "z": "z"}, ("frame_id", "stamp_us"))
    return rows.groupBy("frame_id", "stamp_us").agg(F.count("*").alias("n"), F.max("point_idx").alias("last_idx"), c.rounded(F.max("x"), 6).alias("most_x"), c.rounded(F.min("y"), 6).alias("least_y"))


def recording_scan(spark, d):
    """Points of a recording, read by the data source with the range and doppler gates pushed into it."""
    register(spark)
    path = new_folder(spark, "recording") + "/table"
    recorded(_messages(spark, d), path)
    near = range_gate(1.0, 2.0) & (F.col("doppler") >= 0)
    with settings(spark, {"spark.sql.python.filterPushdown.enabled": "true"}):
        rows = spark.read.format("plumbline_recording").schema("frame_id long, k1 double, k2 double, k3 double, k4 double, x double, y double, z double, intensity double, doppler double, range double").load(path)
        rows = rows.where((F.col("range") >= 1.0) & (F.col("range") <= 2.0) & (F.col("doppler") >= 0)).withColumnRenamed("intensity", "snr")
        return written(_scanned(rows.where(near)), "scan")


QUERIES = {f.__name__: f for f in (frame_roots, frame_lookup, packed_scan, packed_select, recording_scan)}

_EDGES = f"""e AS (SELECT o_custkey AS child, CASE WHEN o_orderkey % 11 = 0 THEN 1000000 + o_custkey % 7 WHEN o_custkey % 8 = 0 THEN o_custkey // 8 ELSE o_custkey - 1 END AS parent, o_orderkey AS i,
            (o_orderkey % 7 - 3) / 40 AS a, (o_orderkey % 5 - 2) / 40 AS b, (o_orderkey % 3 - 1) / 40 AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders),
        p AS MATERIALIZED (SELECT child, parent, i % 11 / 97 * {c.UNIT!r}::DOUBLE AS tx, (i % 13 / 101 - 0.05::DOUBLE) * {c.UNIT!r}::DOUBLE AS ty, i % 17 / 193 * {c.UNIT!r}::DOUBLE AS tz,
            a / sqrt(1 + a * a + b * b + c * c) AS qx, b / sqrt(1 + a * a + b * b + c * c) AS qy, c / sqrt(1 + a * a + b * b + c * c) AS qz, 1 / sqrt(1 + a * a + b * b + c * c) AS qw FROM e WHERE n = 1)"""


def _turned(q: str, t: str, back: bool = False) -> list[str]:
    """SQL of a point turned by a quaternion, by its matrix."""
    x, y, z = (f"({'-' if back else ''}{q}q{a})" for a in "xyz")
    w = f"{q}qw"
    m = [
        f"(1 - 2 * ({y} * {y} + {z} * {z}))", f"2 * ({x} * {y} - {z} * {w})", f"2 * ({x} * {z} + {y} * {w})", f"2 * ({x} * {y} + {z} * {w})", f"(1 - 2 * ({x} * {x} + {z} * {z}))",
        f"2 * ({y} * {z} - {x} * {w})", f"2 * ({x} * {z} - {y} * {w})", f"2 * ({y} * {z} + {x} * {w})", f"(1 - 2 * ({x} * {x} + {y} * {y}))",
    ]
    p = t.split(",")
    return [f"({m[3 * i]} * {p[0]} + {m[3 * i + 1]} * {p[1]} + {m[3 * i + 2]} * {p[2]})" for i in range(3)]


def _product(a: str, b: str, back: bool = False) -> list[str]:
    s_ = "-" if back else ""
    ax, ay, az, aw = f"({s_}{a}qx)", f"({s_}{a}qy)", f"({s_}{a}qz)", f"{a}qw"
    bx, by, bz, bw = (f"{b}q{n}" for n in "xyzw")
    return [f"({aw} * {bx} + {ax} * {bw} + {ay} * {bz} - {az} * {by})", f"({aw} * {by} - {ax} * {bz} + {ay} * {bw} + {az} * {bx})", f"({aw} * {bz} + {ax} * {by} - {ay} * {bx} + {az} * {bw})", f"({aw} * {bw} - {ax} * {bx} - {ay} * {by} - {az} * {bz})"]


_UP = ", ".join(f"{x} + p.t{n} AS t{n}" for x, n in zip(_turned("p.", "u.tx,u.ty,u.tz"), "xyz", strict=True)) + ", " + ", ".join(f"{x} AS q{n}" for x, n in zip(_product("p.", "u."), "xyzw", strict=True))
#: Every frame followed up edge by edge, to a frame without a parent; 200 edges are more than any chain has.
_ROOTS = f"""WITH RECURSIVE {_EDGES},
        u AS (SELECT child AS frame, parent AS root, 1 AS depth, tx, ty, tz, qx, qy, qz, qw FROM p
              UNION ALL SELECT frame, p.parent, depth + 1, {_UP} FROM u JOIN p ON p.child = u.root WHERE depth < 200),
        r AS MATERIALIZED (SELECT * EXCLUDE (depth) FROM u WHERE root NOT IN (SELECT child FROM p)
              UNION ALL SELECT DISTINCT parent, parent, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE FROM p WHERE parent NOT IN (SELECT child FROM p))"""
_MOVED = [f"(s.t{n} - t.t{n})" for n in "xyz"]
_FOUND = ", ".join(f"{x} AS t{n}" for x, n in zip(_turned("t.", ",".join(_MOVED), True), "xyz", strict=True)) + ", " + ", ".join(f"{x} AS q{n}" for x, n in zip(_product("t.", "s.", True), "xyzw", strict=True))
_SIGN = "CASE WHEN qw < 0 THEN -1 ELSE 1 END"
_SCAN = f"SELECT frame_id, {', '.join(f'{k}::DOUBLE AS {k}' for k in KEY)}, {', '.join(f'{c.r(n)} AS {n}' for n in ('x', 'y', 'z', 'snr', 'doppler'))} FROM points"

ORACLES = {
    "frame_roots": f"{_ROOTS} SELECT frame, root, {', '.join(f'{c.r(f"t{n}")} AS t{n}' for n in 'xyz')}, {', '.join(f'{c.r(f"q{n} * {_SIGN}")} AS q{n}' for n in 'xyzw')} FROM r",
    "frame_lookup": f"""{_ROOTS}, f AS (SELECT c_custkey AS source, c_custkey * 7 % 1000 + 1 AS target, s.root IS NOT NULL AND s.root = t.root AS same, {_FOUND}
            FROM customer LEFT JOIN r s ON s.frame = c_custkey LEFT JOIN r t ON t.frame = c_custkey * 7 % 1000 + 1)
        SELECT source, target, {', '.join(f'CASE WHEN same THEN {c.r(f"t{n}")} END AS t{n}' for n in 'xyz')}, {', '.join(f'CASE WHEN same THEN {c.r(f"q{n} * {_SIGN}")} END AS q{n}' for n in 'xyzw')},
               {', '.join(f'CASE WHEN same THEN {c.r(f"-{x}")} END AS {n}' for x, n in zip(_turned('', 'tx,ty,tz', True), ('bx', 'by_', 'bz'), strict=True))} FROM f""",
    "packed_scan": f"WITH {c.POINTS} {_SCAN}",
    "packed_select": f"""WITH {c.POINTS} SELECT frame_id, 1600000000000000 + frame_id * 100000 AS stamp_us, count(*) AS n, (count(*) - 1)::INTEGER AS last_idx, {c.r('max(x)')} AS most_x, {c.r('min(y)')} AS least_y FROM points GROUP BY frame_id""",
    "recording_scan": f"WITH {c.POINTS} {_SCAN} WHERE sqrt(x * x + y * y + z * z) BETWEEN 1.0 AND 2.0 AND doppler >= 0",
}

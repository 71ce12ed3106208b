"""Queries of camera-to-camera pairs: composition, pooling, convergence, placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators import long
from plumbline.operators import posepool as o
from plumbline.plans import common as c
from plumbline.schemas import Params
from plumbline.sources import sinks
from plumbline.sources import tables as s
from plumbline.storage import new_folder, written

PARAMS = Params()


def _poses(spark, d):
    """orders as relative poses: small turns and shifts, half of the quaternions with the other sign."""
    k = F.col("o_custkey")
    raw = [(x / 40).cast("double") for x in (k % 7 - 3, k % 5 - 2, k % 3 - 1)]
    rows = s.table(spark, d, "orders").select(
        F.floor(F.col("o_orderkey") / 2000).alias("session"), F.col("o_orderkey").alias("seq"), *[x.alias(n) for x, n in zip(raw, ("a", "b", "e"), strict=True)],
        F.when(F.col("o_orderkey") % 2 == 0, 1.0).otherwise(-1.0).alias("sign"),
        ((1 + (k % 11) / 97) * c.UNIT).alias("tx"), (((k % 13) / 101 - 0.05) * c.UNIT).alias("ty"), ((0.3 + (k % 17) / 193) * c.UNIT).alias("tz"),
    )
    size = F.col("sign") / F.sqrt(1 + F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("e") * F.col("e"))
    return rows.select("session", "seq", (F.col("a") * size).alias("qx"), (F.col("b") * size).alias("qy"), (F.col("e") * size).alias("qz"), size.alias("qw"), "tx", "ty", "tz")


_MEAN = ["mqx", "mqy", "mqz", "mqw", "mtx", "mty", "mtz"]


def pose_message_decode(spark, d):
    """Pose messages as matrices."""
    m = g.matrix_of_quaternion(g.vec(*o.Q))
    return c.rounded_all(_poses(spark, d).select("seq", *[x.alias(f"m{i}") for i, x in enumerate(m)], *o.T), [])


def mean_poses(spark, d):
    """Each session's mean pose, not rounded."""
    return o.normalised(_poses(spark, d).groupBy("session").agg(*o.se3_mean_columns()))


def se3_mean(spark, d):
    return c.rounded_all(mean_poses(spark, d), [])


def pool_running_mean(spark, d):
    return c.rounded_all(o.running_means(_poses(spark, d), PARAMS.pool_cap), [])


def _converging(spark, d):
    return o.convergence(_poses(spark, d), PARAMS)


def convergence_gate(spark, d):
    """Spreads of the last means, and whether they and the pool pass."""
    return c.rounded_all(_converging(spark, d).select("session", "seq", "pooled", "t_std", "rot_std", "stable"), [])


def convergence_latch(spark, d):
    """Runs of converged rows, and the first long enough."""
    return _converging(spark, d).select("session", "seq", F.col("run").cast("long").alias("run"), "locked_at", "locked")


def value_latch(spark, d):
    """Runs of low values of a session's events, and the first long enough."""
    rows = s.table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("value") < 60).alias("stable"))
    return o.latched(rows, 6).select("session", "seq", "run", "locked_at", "locked")


#: Rows of a span in the queries over one long session, a few of which must hold the pool.
SPAN = 1500


def _one_session(spark, d):
    return _poses(spark, d).withColumn("session", F.lit(0).cast("long"))


def long_pool_mean(spark, d):
    """The running mean of all poses as one session, spread over spans."""
    return c.rounded_all(long.running_means(_one_session(spark, d), PARAMS.pool_cap, SPAN).select("session", "seq", "pooled", *_MEAN), [])


def long_latch(spark, d):
    """Convergence and its lock of all poses as one session."""
    return long.convergence(_one_session(spark, d), PARAMS, SPAN).select("session", "seq", F.col("run").cast("long").alias("run"), "locked_at", "locked")


def long_runs(spark, d):
    """Runs of low values of all events as one session, and the first long enough."""
    rows = s.table(spark, d, "events").select(F.lit(0).cast("long").alias("session"), F.col("event_id").alias("seq"), (F.col("value") < 60).alias("stable"))
    return long.latched(long.numbered(rows, "seq"), 6, 700).select("session", "seq", "run", "locked_at", "locked")


#: The pose of the target in camera A.
A_Q = (0.2, -0.4, -0.4, 0.8)


def _target_poses(spark, d):
    """The target as both cameras see it: in A at one pose, in B at the orders' poses, some with too large an error."""
    b = _poses(spark, d).join(s.table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 9 / 4).alias("reproj")), "seq")
    a = b.select("session", "seq", F.lit(0.5).alias("reproj"), *[F.lit(x).alias(n) for x, n in zip((*A_Q, *c.T), (*o.Q, *o.T), strict=True)])
    return a, b


def pair_calibration(spark, d):
    """Composition to lock in one path: live estimates, then the locked one."""
    return c.rounded_all(o.calibrated_pairs(*_target_poses(spark, d), PARAMS), [])


def pair_solution_document(spark, d):
    """The document of every live and locked estimate, written as text and JSON and read again from
    JSON; a lock whose world pose is known has the pose in the world as well."""
    a, b = _target_poses(spark, d)
    rows = written(o.calibrated_pairs(a, b, PARAMS), "estimates").join(b.select("session", "seq", F.col("reproj").alias("reproj_b")), ["session", "seq"])
    rows = _in_world(rows.withColumns({"reproj_a": F.lit(0.5), "stamp": F.col("seq") * 1000}))
    rows = o.in_world(rows.withColumn("wtx", F.when(F.col("stage") == "locked", F.col("wtx"))))
    names = {"parent_frame": "camera_a", "child_frame": "camera_b", "camera_a_name": "left", "camera_b_name": "right", "world_frame": "map"}
    path = new_folder(spark, "pairs")
    sinks.written_documents(sinks.as_documents(sinks.pair_document(rows, names), "session"), path)
    shape = "session long, seq long, child_frame string, camera_b_name string, stage string, stamp long, reproj_a_px double, reproj_b_px double, world_frame string, translation array<double>, quaternion_xyzw array<double>, pose_in_map_translation array<double>"
    back = spark.read.schema(shape).json(f"{path}/json")
    lists = {"translation": ("t", 3), "quaternion_xyzw": ("q", 4), "pose_in_map_translation": ("w", 3)}
    flat = [c.rounded(F.get(n, F.lit(i))).alias(f"{x}{i}") for n, (x, size) in lists.items() for i in range(size)]
    return back.select(*[n for n in back.columns if n not in lists], *flat)


def locked_placement(spark, d):
    """Where each session's lock puts camera B, with the world pose known at the lock."""
    locked = o.calibrated_pairs(*_target_poses(spark, d), PARAMS).where("stage = 'locked'")
    return _placed(_in_world(written(locked, "locked")))  # read once for each mode


def _in_world(poses):
    tx = F.when(F.col("session") != 3, F.col("session") * 0.5)
    return poses.withColumns(
        {"camera_a": F.concat(F.lit("a"), F.col("session")), "camera_b": F.concat(F.lit("b"), F.col("seq")), "wtx": tx, "wty": F.lit(0.1), "wtz": F.lit(-0.2), "wqx": F.lit(0.0), "wqy": F.lit(0.0), "wqz": F.lit(0.6), "wqw": F.lit(0.8)}
    )


def _placed(w):
    out = [o.placement(w, mode).withColumn("mode", F.lit(mode)) for mode in ("none", "fixed", "moving")]
    return c.rounded_all(out[0].unionByName(out[1]).unionByName(out[2]).select("mode", "parent", "child", *o.T), [])


def placement(spark, d):
    return _placed(_in_world(_poses(spark, d)))


def pose_in_world(spark, d):
    return c.rounded_all(o.placement(_in_world(_poses(spark, d)), "fixed"), [])


def pair_compose(spark, d):
    """Relative pose from two poses of one target, A times the inverse of B."""
    r, t = g.constant(c.R), g.constant(c.T)
    m, v = g.composed(r, t, *g.inverted(g.matrix_of_quaternion(g.vec(*o.Q)), g.vec(*o.T)))
    return c.rounded_all(_poses(spark, d).select("seq", m[0].alias("m00"), m[5].alias("m12"), *[x.alias(n) for x, n in zip(v, o.T, strict=True)]), [])


QUERIES = {f.__name__: f for f in (pose_message_decode, se3_mean, pool_running_mean, convergence_gate, convergence_latch, value_latch, long_pool_mean, long_latch, long_runs, pair_calibration, pair_solution_document, locked_placement, placement, pose_in_world, pair_compose)}

_POSES = f"""raw AS (SELECT o_orderkey // 2000 AS session, o_orderkey AS seq, (o_custkey % 7 - 3) / 40 AS a, (o_custkey % 5 - 2) / 40 AS b, (o_custkey % 3 - 1) / 40 AS e,
        CASE WHEN o_orderkey % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign, (1 + (o_custkey % 11) / 97) * {c.UNIT!r}::DOUBLE AS tx, ((o_custkey % 13) / 101 - 0.05::DOUBLE) * {c.UNIT!r}::DOUBLE AS ty, (0.3::DOUBLE + (o_custkey % 17) / 193) * {c.UNIT!r}::DOUBLE AS tz FROM orders),
    poses AS (SELECT session, seq, a * s AS qx, b * s AS qy, e * s AS qz, s AS qw, tx, ty, tz FROM (SELECT *, sign / sqrt(1 + a * a + b * b + e * e) AS s FROM raw))"""
_M = ["1 - 2 * (qy * qy + qz * qz)", "2 * (qx * qy - qz * qw)", "2 * (qx * qz + qy * qw)", "2 * (qx * qy + qz * qw)", "1 - 2 * (qx * qx + qz * qz)", "2 * (qy * qz - qx * qw)", "2 * (qx * qz - qy * qw)", "2 * (qy * qz + qx * qw)", "1 - 2 * (qx * qx + qy * qy)"]
_SUMS = ", ".join(f"avg({q} * sign(qw)) {{over}} AS {q}" for q in o.Q) + ", " + ", ".join(f"avg({t}) {{over}} AS {t}" for t in o.T)
_NORMAL = ", ".join(f"{q} / sqrt(qx * qx + qy * qy + qz * qz + qw * qw) AS m{q}" for q in o.Q) + ", " + ", ".join(f"{t} AS m{t}" for t in o.T)


def _means(rows: str = "poses") -> str:
    return f"""s AS (SELECT session, seq, count(*) OVER w AS pooled, {_SUMS.format(over='OVER w')} FROM {rows}
            WINDOW w AS (PARTITION BY session ORDER BY seq ROWS BETWEEN {PARAMS.pool_cap - 1} PRECEDING AND CURRENT ROW)),
        m AS (SELECT session, seq, pooled, {_NORMAL} FROM s)"""


def _converged(rows: str = "poses") -> str:
    """Spreads of the means, the flag, runs of it, and the lock."""
    p = PARAMS
    return f"""{_means(rows)}, l AS (SELECT *, sqrt(mqx * mqx + mqy * mqy + mqz * mqz) AS n FROM m),
        v AS (SELECT *, CASE WHEN n < 1e-12 THEN 2 ELSE 2 * atan2(n, mqw) / n END AS f FROM l),
        c AS (SELECT *, count(*) OVER w AS k, sqrt(var_pop(mtx) OVER w + var_pop(mty) OVER w + var_pop(mtz) OVER w) AS t_std,
                     degrees(sqrt(var_pop(mqx * f) OVER w + var_pop(mqy * f) OVER w + var_pop(mqz * f) OVER w)) AS rot_std
              FROM v WINDOW w AS (PARTITION BY session ORDER BY seq ROWS BETWEEN {p.conv_window - 1} PRECEDING AND CURRENT ROW)),
        t AS (SELECT *, k >= {p.conv_window} AND t_std < {p.conv_t_std} AND rot_std < {p.conv_rot_std_deg} AND pooled > {p.conv_pool} AS stable FROM c),
        b AS (SELECT *, sum(CASE WHEN stable THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY seq) AS g FROM t),
        r AS (SELECT *, sum(CASE WHEN stable THEN 1 ELSE 0 END) OVER (PARTITION BY session, g ORDER BY seq)::BIGINT AS run FROM b),
        k AS (SELECT session, min(seq) AS locked_at FROM r WHERE run >= {p.conv_hold} GROUP BY session),
        conv AS (SELECT r.*, locked_at FROM r LEFT JOIN k USING (session))"""


#: A times the inverse of B, by quaternions.
_A = dict(zip("xyzw", A_Q, strict=True))
_PAIRED = f"""x AS (
        SELECT session, seq, tx, ty, tz, {_A['w']} * -qx + {_A['x']} * qw + {_A['y']} * -qz - {_A['z']} * -qy AS qx, {_A['w']} * -qy - {_A['x']} * -qz + {_A['y']} * qw + {_A['z']} * -qx AS qy,
               {_A['w']} * -qz + {_A['x']} * -qy - {_A['y']} * -qx + {_A['z']} * qw AS qz, {_A['w']} * qw + {_A['x']} * qx + {_A['y']} * qy + {_A['z']} * qz AS qw
        FROM poses JOIN orders ON o_orderkey = seq WHERE o_custkey % 9 / 4 <= 1.5),
    y AS (SELECT session, seq, qx, qy, qz, qw, {', '.join(f'{m} AS m{i}' for i, m in enumerate(_M))}, tx, ty, tz FROM x),
    paired AS (SELECT session, seq, qx, qy, qz, qw, {', '.join(f'({t}::DOUBLE) - (m{3 * i} * tx + m{3 * i + 1} * ty + m{3 * i + 2} * tz) AS {n}' for i, (t, n) in enumerate(zip(c.T, o.T, strict=True)))} FROM y),
    {_converged('paired')},
    upto AS (SELECT session, seq, pooled, CASE WHEN seq = locked_at THEN 'locked' ELSE 'live' END AS stage, {', '.join(f'm{n} AS {n}' for n in (*o.Q, *o.T))} FROM conv WHERE locked_at IS NULL OR seq <= locked_at)"""
_MEANS = f"{_POSES}, {_means()}"
_ROUNDED = ", ".join(f"{c.r(x)} AS {x}" for x in _MEAN)
#: World pose: a turn of 2 atan2(0.6, 0.8) about z, and the shift (session / 2, 0.1, -0.2).
_WORLD_T = ["session * 0.5 + 0.28 * tx - 0.96 * ty", "0.1 + 0.96 * tx + 0.28 * ty", "-0.2 + tz"]
_WORLD_Q = ["0.8 * qx - 0.6 * qy", "0.8 * qy + 0.6 * qx", "0.8 * qz + 0.6 * qw", "0.8 * qw - 0.6 * qz"]
_T = lambda xs: ", ".join(f"{c.r(x)} AS {n}" for x, n in zip(xs, o.T, strict=True))

ORACLES = {
    "pose_message_decode": f"WITH {_POSES} SELECT seq, {', '.join(f'{c.r(x)} AS m{i}' for i, x in enumerate(_M))}, {_T(o.T)} FROM poses",
    "se3_mean": f"WITH {_POSES}, s AS (SELECT session, {_SUMS.format(over='')} FROM poses GROUP BY session), m AS (SELECT session, {_NORMAL} FROM s) SELECT session, {_ROUNDED} FROM m",
    "pool_running_mean": f"WITH {_MEANS} SELECT session, seq, pooled, {_ROUNDED} FROM m",
    "convergence_gate": f"""WITH {_POSES}, {_converged()} SELECT session, seq, pooled, CASE WHEN k >= {PARAMS.conv_window} THEN {c.r('t_std')} END AS t_std,
        CASE WHEN k >= {PARAMS.conv_window} THEN {c.r('rot_std')} END AS rot_std, stable FROM conv""",
    "convergence_latch": f"WITH {_POSES}, {_converged()} SELECT session, seq, run, locked_at, coalesce(seq >= locked_at, false) AS locked FROM conv",
    "pair_calibration": f"WITH {_POSES}, {_PAIRED} SELECT session, seq, pooled, stage, {', '.join(f'{c.r(n)} AS {n}' for n in (*o.Q, *o.T))} FROM upto",
    "pair_solution_document": f"""WITH {_POSES}, {_PAIRED}, w AS (SELECT *, CASE WHEN stage = 'locked' AND session <> 3 THEN 1 END AS known FROM upto)
        SELECT session, seq, 'camera_b' AS child_frame, 'right' AS camera_b_name, stage, seq * 1000 AS stamp, 0.5::DOUBLE AS reproj_a_px, o_custkey % 9 / 4 AS reproj_b_px, CASE WHEN known = 1 THEN 'map' END AS world_frame,
            {', '.join(f'{c.r(n)} AS t{i}' for i, n in enumerate(o.T))}, {', '.join(f'{c.r(n)} AS q{i}' for i, n in enumerate(o.Q))}, {', '.join(f'CASE WHEN known = 1 THEN {c.r(x)} END AS w{i}' for i, x in enumerate(_WORLD_T))}
        FROM w JOIN orders ON o_orderkey = seq""",
    "locked_placement": f"""WITH {_POSES}, {_PAIRED}, w AS (SELECT * FROM upto WHERE stage = 'locked')
        SELECT 'none' AS mode, 'a' || session AS parent, 'b' || seq AS child, {_T(o.T)} FROM w
        UNION ALL SELECT 'fixed', 'world', 'b' || seq, {_T(_WORLD_T)} FROM w WHERE session <> 3""",
    "long_pool_mean": f"WITH {_POSES}, one AS (SELECT * REPLACE (0::BIGINT AS session) FROM poses), {_means('one')} SELECT session, seq, pooled, {_ROUNDED} FROM m",
    "long_latch": f"WITH {_POSES}, one AS (SELECT * REPLACE (0::BIGINT AS session) FROM poses), {_converged('one')} SELECT session, seq, run, locked_at, coalesce(seq >= locked_at, false) AS locked FROM conv",
    "long_runs": """WITH e AS (SELECT 0::BIGINT AS session, event_id AS seq, value < 60 AS stable FROM events),
        b AS (SELECT *, sum(CASE WHEN stable THEN 0 ELSE 1 END) OVER (ORDER BY seq) AS g FROM e),
        n AS (SELECT *, sum(CASE WHEN stable THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY seq)::BIGINT AS run FROM b)
        SELECT session, seq, run, (SELECT min(seq) FROM n WHERE run >= 6) AS locked_at, coalesce(seq >= (SELECT min(seq) FROM n WHERE run >= 6), false) AS locked FROM n""",
    "value_latch": """WITH e AS (SELECT user_id AS session, event_id AS seq, value < 60 AS stable FROM events),
        b AS (SELECT *, sum(CASE WHEN stable THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY seq) AS g FROM e),
        n AS (SELECT *, sum(CASE WHEN stable THEN 1 ELSE 0 END) OVER (PARTITION BY session, g ORDER BY seq)::BIGINT AS run FROM b),
        l AS (SELECT session, min(seq) AS locked_at FROM n WHERE run >= 6 GROUP BY session)
        SELECT session, seq, run, locked_at, coalesce(seq >= locked_at, false) AS locked FROM n LEFT JOIN l USING (session)""",
    "placement": f"""WITH {_POSES}, w AS (SELECT * FROM poses)
        SELECT 'none' AS mode, 'a' || session AS parent, 'b' || seq AS child, {_T(o.T)} FROM w
        UNION ALL SELECT 'fixed', 'world', 'b' || seq, {_T(_WORLD_T)} FROM w WHERE session <> 3""",
    "pose_in_world": f"""WITH {_POSES}, w AS (SELECT seq, {', '.join(f'{x} AS {n}' for x, n in zip(_WORLD_T, o.T, strict=True))}, {', '.join(f'{x} AS {n}' for x, n in zip(_WORLD_Q, o.Q, strict=True))} FROM poses WHERE session <> 3)
        SELECT 'world' AS parent, 'b' || seq AS child, {_T(o.T)}, {', '.join(f'{c.r(f"{q} * CASE WHEN qw < 0 THEN -1 ELSE 1 END")} AS {q}' for q in o.Q)} FROM w""",
    "pair_compose": f"""WITH {_POSES}, b AS (SELECT seq, {', '.join(f'{x} AS m{i}' for i, x in enumerate(_M))}, tx, ty, tz FROM poses),
        i AS (SELECT *, -(m0 * tx + m3 * ty + m6 * tz) AS x, -(m1 * tx + m4 * ty + m7 * tz) AS y, -(m2 * tx + m5 * ty + m8 * tz) AS z FROM b)
        SELECT seq, {c.r('0.36 * m0 + 0.48 * m1 - 0.8 * m2')} AS m00, {c.r('-0.8 * m6 + 0.6 * m7')} AS m12, {_T(c.rigid_sql(c.R, c.T, ['x', 'y', 'z']))} FROM i""",
}

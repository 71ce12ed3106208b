"""Queries of the estimators and of the checks on what they give."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators import estimate as e
from plumbline.operators import posefit
from plumbline.operators import validate as v
from plumbline.operators.estimate import Rotation
from plumbline.plans import common as c
from plumbline.schemas import Params
from plumbline.sources import scenes, sinks
from plumbline.sources import tables as s
from plumbline.storage import new_folder, written

#: The scenes have no noise, so without the prior's pull solutions are the truth and SQL can state them.
PARAMS = Params().with_values(measured_baseline_m=0.35, use_prior=False, offset_prior_sigma_m=0.01)
CAPTURES = 20
TRUE_R, TRUE_T = (x.ravel().tolist() for x in scenes.truth(PARAMS))
_C, _P = ("cx", "cy", "cz"), ("px", "py", "pz")
_PQ = {"qx": "cx", "qy": "cy", "qz": "cz"}


def _tracks(spark, d):
    return s.tracks(spark, d)


def _in_unit(spark, d):
    return _tracks(spark, d).withColumns({n: F.col(n) * c.UNIT for n in (*_C, *_P)})


def _scene(spark, d, n=CAPTURES):
    """A scene of exact captures for each supplier."""
    return scenes.capture_scene(s.table(spark, d, "supplier").select(F.col("s_suppkey").alias("session")), n, noise=0.0, params=PARAMS)


def _rt():
    return g.constant(c.R), g.constant(c.T)


def centroid_crosscov(spark, d):
    return c.rounded_all(e.cross_covariance(_in_unit(spark, d).withColumnsRenamed({b: a for a, b in _PQ.items()})), [], 5)


def kabsch_fit(spark, d):
    """Points against their rigid images: the literal rotation and translation come back."""
    r, t = _rt()
    moved = _tracks(spark, d).withColumns(dict(zip(_PQ, g.rigid(r, t, v.sensed()), strict=True)))
    got = e.kabsch(moved)
    return c.rounded_all(got.select("session", "n", *[F.get("r", F.lit(i)).alias(f"r{i}") for i in range(9)], *[F.get("t", F.lit(i)).alias(f"t{i}") for i in range(3)]), [], 5)


def error_stats(spark, d):
    return c.rounded_all(v.error_stats(v.with_residuals(_tracks(spark, d), *_rt())), [])


def rms_bias(spark, d):
    """Errors of the identity."""
    eye, zero = g.constant([1, 0, 0, 0, 1, 0, 0, 0, 1]), g.constant([0, 0, 0])
    return c.rounded_all(v.error_stats(v.with_residuals(_tracks(spark, d), eye, zero)).select("session", "rms_mm", "worst_bias_mm"), [])


def pixel_error(spark, d):
    eye, zero = g.constant([1, 0, 0, 0, 1, 0, 0, 0, 1]), g.constant([0.01, 0, 0])
    return c.rounded_all(v.pixel_errors(_tracks(spark, d).where("cz > 0.1 and pz > 0.1"), eye, zero, g.constant(c.K), g.constant([0.0] * 5)), [])


def spread_guard(spark, d):
    return c.rounded_all(v.spread(_tracks(spark, d)), [])


def elevation_detect(spark, d):
    a = v.elevation_spread(_tracks(spark, d)).withColumn("signed", F.lit(False))
    return c.rounded_all(a.unionByName(v.elevation_spread(_tracks(spark, d), signed=True).withColumn("signed", F.lit(True))), [])


def range_fit(spark, d):
    return c.rounded_all(v.range_fit(_tracks(spark, d), PARAMS.with_values(range_scale=1.01, range_bias_m=0.02)), [], 5)


def scatter_sums(spark, d):
    return c.rounded_all(v.scatter(_in_unit(spark, d)), [], 5)


def condition_planarity(spark, d):
    """Customers' points: two on each axis, so the scatter is diagonal; a third of them flat."""
    k = F.col("c_custkey")
    size = [(1 + k % 7) / 4, (1 + k % 5) / 3, F.when(k % 3 == 0, 0.0).otherwise((1 + k % 4) / 16)]
    ends = F.explode(F.array(*[F.array(*[x * sign if i == j else F.lit(0.0) for j, x in enumerate(size)]) for i in range(3) for sign in (1.0, -1.0)]))
    rows = s.table(spark, d, "customer").select(k.alias("session"), ends.alias("p"))
    rows = rows.select("session", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("px", "py", "pz"))])
    return c.rounded_all(v.condition(rows), [])


def inlier_floor(spark, d):
    """Clicks' values as errors by user; the limit is strict for many users, so the floor acts."""
    rows = s.table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), F.col("value").alias("e"))
    return v.inlier_floor(rows, 20.0)


def rotation_mean_chordal(spark, d):
    """Customers' rotations: a turn about z and equal turns about x to both sides of it, whose mean is the turn about z."""
    k = F.col("c_custkey")
    turn, tilt = F.radians((k % 170).cast("double")), F.explode(F.array(*[F.lit(x) for x in (-0.6, -0.2, 0.0, 0.2, 0.6)]))
    rows = s.table(spark, d, "customer").select(k.alias("session"), turn.alias("a"), tilt.alias("b"))
    ca, sa, cb, sb = F.cos("a"), F.sin("a"), F.cos("b"), F.sin("b")
    rb = F.array(ca, -sa * cb, sa * sb, sa, ca * cb, -ca * sb, F.lit(0.0), sb, cb)
    got = e.chordal_means(rows.select("session", rb.alias("rb")))
    return c.rounded_all(got.select("session", "n", *[F.get("r", F.lit(i)).alias(f"r{i}") for i in range(9)]), [])


def _solution(rows):
    """A solution's numbers as columns."""
    parts = [("r", 9), ("t", 3), ("offset", 3)]
    return rows.select("session", "status", "n_captures", "n_inliers", "n_rejected", "elevation_used", "converged", *[c.rounded(F.get(n, F.lit(i)), 5).alias(f"{n}{i}") for n, size in parts for i in range(size)])


def solve_extrinsic(spark, d):
    return _solution(e.solved(_scene(spark, d), PARAMS))


def solve_forced(spark, d):
    """Solves on command from three captures, too few for the estimator, and from four."""
    few = e.solved(_scene(spark, d, 3), PARAMS)
    return _solution(few.unionByName(e.solved(_scene(spark, d, 4), PARAMS))).select("session", "status", "n_captures", "n_inliers")


def loo_folds(spark, d):
    captures = written(_scene(spark, d), "captures")
    return c.rounded_all(e.leave_one_out(captures, written(e.solved(captures, PARAMS), "solutions"), PARAMS), [], 4)


#: Captures with noise and wrong readings, under the priors: the published defaults.
NOISY = Params()
NOISE = (NOISY.sigma_range_m, float(np.radians(NOISY.sigma_az_deg)), float(np.radians(2.0)))


def _noisy(spark, d):
    return s.noisy_captures(spark, d, TRUE_R, TRUE_T, NOISY.offset, NOISE)


def solve_noisy(spark, d):
    """Solves of the rigs' captures: which are left out, and whether pose, offset and sigmas are what they can be."""
    got = e.solved(_noisy(spark, d), NOISY)
    cosine = (sum((F.get("r", F.lit(i)) * x for i, x in enumerate(TRUE_R)), F.lit(0.0)) - 1) / 2  # of the angle to the true rotation
    away = lambda n, want: F.sqrt(sum(((F.get(n, F.lit(i)) - x) ** 2 for i, x in enumerate(want)), F.lit(0.0)))
    sure = F.forall("sigma", lambda x: (x > 0) & (x < 0.2)) & F.forall("offset_sigma", lambda x: (x > 0) & (x <= NOISY.offset_prior_sigma_m * 1.001))
    checks = {"near_rotation": cosine > float(np.cos(np.radians(8))), "near_translation": away("t", TRUE_T) < 0.12, "near_offset": away("offset", NOISY.offset) < 0.15, "sure": sure, "fits": (F.col("rms_sigma") > 0) & (F.col("rms_sigma") < 1.2)}
    out = got.select("session", "status", "n_captures", "n_inliers", "n_rejected", F.concat_ws(",", "inliers").alias("inliers"), "rank", *[x.alias(n) for n, x in checks.items()])
    return out


def loo_noisy(spark, d):
    """Every inlier left out of a fit without priors: folds, and whether their errors are those of noise."""
    captures = written(_noisy(spark, d), "captures")
    folds = e.leave_one_out(captures, written(e.solved(captures, NOISY), "solutions"), NOISY)
    return folds.select("session", "fold", ((F.col("sigma_error") > 0) & (F.col("sigma_error") < 4)).alias("fair"))


def fold_exclusion_join(spark, d):
    """Every fold's count and mean of the session's other captures: the session's less its own."""
    rows = s.table(spark, d, "supplier").select(F.col("s_nationkey").alias("session"), F.col("s_suppkey").alias("capture_no"), F.col("s_acctbal").alias("value"))
    return e.fold_exclusion(rows).select("session", "capture_no", "n_train", c.rounded("mean_train", 4).alias("mean_train"))


def _sigmas(spark, d):
    rows = s.table(spark, d, "customer")
    sig = F.array(*[(F.col("c_custkey") % m) / k for m, k in ((7, 20.0), (5, 15.0), (3, 5.0), (11, 60.0), (13, 60.0), (2, 5.0))])
    return rows.select("c_custkey", sig.alias("sigma"), F.array((F.col("c_custkey") % 9) / 200.0).alias("offset_sigma"), F.col("c_acctbal").alias("bal"))


def observability(spark, d):
    return _sigmas(spark, d).select("c_custkey", F.concat_ws(",", v.weak_freedoms(F.col("sigma"), F.col("offset_sigma"))).alias("weak"))


def verdict(spark, d):
    rows = _sigmas(spark, d).withColumn("n_weak", F.size(v.weak_freedoms(F.col("sigma"))))
    px = F.when(F.col("c_custkey") % 10 == 0, float("nan")).otherwise(F.abs("bal") / 20)
    return rows.select("c_custkey", v.verdict(px, F.abs("bal") / 50, F.abs("bal") / 100, F.col("n_weak"), PARAMS).alias("passes"))


def warning_rules(spark, d):
    rows = _sigmas(spark, d)
    flags = v.warnings(F.abs("bal") / 20000, F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey") % 5), F.abs("bal") / 10, F.col("c_custkey") % 2 == 0, PARAMS)
    return rows.select("c_custkey", *[f.alias(n) for n, f in flags.items()])


def _reported(spark, d):
    captures = written(_scene(spark, d), "captures")
    solutions = written(e.solved(captures, PARAMS), "solutions")
    return written(report(captures, solutions, PARAMS), "report")


def solve_end_to_end(spark, d):
    """Captures to the verdict, a row for each session."""
    rows = _reported(spark, d)
    numbers = ("rms_mm", "mean_3d_mm", "worst_bias_mm", "mean_px", "loo_rms_sigma", "loo_max_sigma", "rms_sigma")
    flags = ("low_diversity", "planar", "passes", "warn_baseline", "warn_loo", "warn_condition")
    return rows.select("session", "status", "n_inliers", "n_rejected", *[c.rounded(n, 3).alias(n) for n in numbers], F.concat_ws(",", "unobservable_dof").alias("weak"), *flags)


def solution_document(spark, d):
    """The result document of every session's solve, written as text and JSON and read again from JSON."""
    path = new_folder(spark, "solutions")
    named = {"parent_frame": "camera", "child_frame": "sensor", "camera_name": "left", "radar_name": "front"}
    sinks.written_documents(sinks.as_documents(sinks.extrinsic_document(_reported(spark, d), PARAMS, named, 1_700_000_000_000_000_000), "session"), path)
    wide = "session long, parent_frame string, method string, n_captures int, n_inliers int, n_rejected int, verdict_pass boolean, elevation_used boolean, apex_offset_solved boolean, unobservable_dof array<string>, mean_3d_mm double, radar_noise_sigma_az_deg double, T_cam_radar_translation array<double>, T_cam_radar_quaternion_xyzw array<double>, T_cam_radar_rpy_deg array<double>, T_radar_cam_translation array<double>, apex_offset_measured_prior_m array<double>, stamp long"
    rows = spark.read.schema(wide).json(f"{path}/json")
    lists = {"T_cam_radar_translation": "t", "T_cam_radar_quaternion_xyzw": "q", "T_cam_radar_rpy_deg": "rpy", "T_radar_cam_translation": "back", "apex_offset_measured_prior_m": "apex"}
    flat = [c.rounded(F.get(n, F.lit(i)), 4).alias(f"{x}{i}") for n, x in lists.items() for i in range(4 if x == "q" else 3)]
    plain = [F.col(n) for n in rows.columns if n not in lists and n not in ("unobservable_dof", "mean_3d_mm")]
    return rows.select(*plain, F.concat_ws(",", "unobservable_dof").alias("weak"), c.rounded("mean_3d_mm", 2).alias("mean_3d_mm"), *flat)


def solve_report(spark, d):
    """The line of text that a solve reports."""
    return sinks.report_lines(_reported(spark, d)).select("session", "line")


def report(captures, solutions, p: Params):
    """The validation report: errors of the inliers under the solution, folds, spread, condition, verdict."""
    x = captures.join(solutions.where("status = 'solved'"), "session").where(F.array_contains("inliers", F.col("capture_no")))
    r, t, rb = g.items("r", 9), g.items("t", 3), g.items("rb", 9)
    cam = g.rigid(rb, g.items("tb", 3), g.items("offset", 3))
    named = x.select("session", "sigma", "offset_sigma", "t", "r", *[a.alias(n) for a, n in zip([*g.items("p", 3), *cam], ("px", "py", "pz", "cx", "cy", "cz"), strict=True)])
    inliers = written(named, "inliers")
    errors = v.error_stats(v.with_residuals(inliers, r, t))
    pixels = v.pixel_errors(inliers, r, t, g.constant(c.K), g.constant(c.D))
    loo = e.leave_one_out(captures, solutions, p).groupBy("session").agg(F.sqrt(F.avg(F.col("sigma_error") ** 2)).alias("loo_rms_sigma"), F.max("sigma_error").alias("loo_max_sigma"))
    out = solutions.drop("inliers").join(errors, "session", "left").join(pixels, "session", "left").join(loo, "session", "left").join(v.spread(inliers), "session", "left").join(v.condition(inliers), "session", "left")
    weak = v.weak_freedoms(F.col("sigma"), F.when(F.size("offset_sigma") == 3, F.col("offset_sigma")))
    out = out.withColumn("unobservable_dof", weak)
    hard = F.size(F.array_except("unobservable_dof", F.array(F.lit("offset"))))
    flags = v.warnings(g.norm(g.items("t", 3)), F.col("loo_rms_sigma"), F.col("condition_number"), F.col("planar"), p)
    return out.withColumns({"passes": v.verdict(F.col("mean_px"), F.col("mean_3d_mm"), F.col("worst_bias_mm"), hard, p)} | flags)


def _corners(spark, d, noise_px=0.0):
    """A board seen by a frame for each supplier, turned about its y axis."""
    board = [(r.x, r.y, r.z) for r in s.board_corners(spark, 9, 7, 0.02).orderBy("corner_id").collect()]  # the board's 48
    k, zero = F.col("s_suppkey"), F.lit(0.0)
    pose = {"vx": zero, "vy": (k % 7 - 3) / 10, "vz": zero, "tx": (k % 5 - 2) / 20, "ty": (k % 3 - 1) / 20, "tz": 1 + (k % 11) / 20}
    poses = s.table(spark, d, "supplier").select(k.alias("frame_id"), *[x.cast("double").alias(n) for n, x in pose.items()])
    return scenes.corner_scene(poses, board, c.K, c.D, noise_px)


def board_pose_fit(spark, d):
    got = posefit.board_poses(_corners(spark, d), s.board_corners(spark, 9, 7, 0.02), c.K, c.D, 6, 1.5)
    numbers = [c.rounded(F.get(n, F.lit(i)), 5).alias(f"{n}{i}") for n, size in (("rb", 9), ("tb", 3)) for i in range(size)]
    return got.select("frame_id", *numbers, c.rounded("reproj_l2_over_n", 5).alias("reproj_l2_over_n"), "n_corners")


def board_pose_noisy(spark, d):
    """The same frames with corners that are off by half a pixel: whether poses and their error are as good as that allows."""
    got = posefit.board_poses(_corners(spark, d, 0.5), s.board_corners(spark, 9, 7, 0.02), c.K, c.D, 6, 1.5)
    k = F.col("frame_id")
    a = (k % 7 - 3) / 10
    turn = [F.cos(a), 0.0, F.sin(a), 0.0, 1.0, 0.0, -F.sin(a), 0.0, F.cos(a)]
    shift = [(k % 5 - 2) / 20, (k % 3 - 1) / 20, 1 + k % 11 / 20]
    off = lambda n, want: F.greatest(*[F.abs(F.get(n, F.lit(i)) - x) for i, x in enumerate(want)])
    error = F.col("reproj_l2_over_n")
    return got.select("frame_id", (off("rb", turn) < 0.3).alias("near_rotation"), (off("tb", shift) < 0.05).alias("near_translation"), ((error > 0.02) & (error < 0.2)).alias("error_of_noise"), "n_corners")


def min_corners_having(spark, d):
    rows = s.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"), (F.col("l_partkey") % 48).alias("corner_id"))
    return posefit.enough_corners(rows, 6)


def reproj_gate(spark, d):
    """Poses by their error, the L2 norm of the pixel errors over their number."""
    rows = s.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("frame_id"))
    out = rows.agg((F.sqrt(F.sum(F.col("l_quantity") * F.col("l_quantity"))) / F.count("*")).alias("reproj_l2_over_n"), F.count("*").cast("int").alias("n_corners"))
    return c.rounded_all(out.where("reproj_l2_over_n <= 15"), [])


QUERIES = {
    f.__name__: f
    for f in (centroid_crosscov, kabsch_fit, error_stats, rms_bias, pixel_error, spread_guard, elevation_detect, range_fit, scatter_sums, condition_planarity, inlier_floor, rotation_mean_chordal, solve_extrinsic, solve_forced, solve_noisy, loo_noisy, loo_folds, fold_exclusion_join, observability, verdict, warning_rules, solve_end_to_end, solution_document, solve_report, board_pose_fit, board_pose_noisy, min_corners_having, reproj_gate)
}

_UNIT = f"{c.TRACKS}, u AS (SELECT session, {', '.join(f'{n} * {c.UNIT!r}::DOUBLE AS {n}' for n in (*_C, *_P))} FROM tracks)"
_RES = ", ".join(f"{x} - {q} AS d{a}" for x, q, a in zip(c.rigid_sql(c.R, c.T, list(_P)), _C, "xyz", strict=True))
_SIG = "sig AS (SELECT c_custkey, abs(c_acctbal) AS bal, (c_custkey % 7) / 20 AS a, (c_custkey % 5) / 15 AS b, (c_custkey % 3) / 5 AS c, (c_custkey % 11) / 60 AS d, (c_custkey % 13) / 60 AS e, (c_custkey % 2) / 5 AS f, (c_custkey % 9) / 200 AS o FROM customer)"
_WEAK = [("a > 0.3", "rot_x"), ("b > 0.3", "rot_y"), ("c > 0.3", "rot_z"), ("d > 0.2", "t_x"), ("e > 0.2", "t_y"), ("f > 0.2", "t_z")]
_RANGE = lambda p: f"sqrt({p}x * {p}x + {p}y * {p}y + {p}z * {p}z)"


def _stats(res: str, columns: str) -> str:
    parts = {
        "n": "count(*)", "rms_mm": c.r("sqrt(avg(dx * dx + dy * dy + dz * dz)) * 1000"), "mean_3d_mm": c.r("avg(sqrt(dx * dx + dy * dy + dz * dz)) * 1000"),
        **{f"bias_{a}_mm": c.r(f"avg(d{a}) * 1000") for a in "xyz"}, "worst_bias_mm": c.r("greatest(abs(avg(dx)), abs(avg(dy)), abs(avg(dz))) * 1000"),
    }
    return f"WITH {c.TRACKS}, e AS (SELECT session, {res} FROM tracks) SELECT session, {', '.join(f'{parts[n]} AS {n}' for n in columns.split())} FROM e GROUP BY session"


def _elevation(z: str, signed: str) -> str:
    spread = f"stddev_pop({z} / greatest({_RANGE('p')}, 1e-6))"
    return f"SELECT session, {c.r(spread)} AS el_spread, {spread} > 0.01 AS uses_elevation, {signed} AS signed FROM tracks GROUP BY session"


#: Captures by session, those that are right, and how many aren't.
_RIGS = f"""WITH e AS (SELECT user_id AS session, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // {s.POSE_FRAMES} AS m FROM events), m AS (SELECT DISTINCT session, m FROM e),
    k AS (SELECT session, count(*)::INTEGER AS n, (count(*) FILTER (m % {s.WRONG} = {s.WRONG - 1}))::INTEGER AS wrong, string_agg((m + 1)::VARCHAR, ',' ORDER BY m) FILTER (m % {s.WRONG} <> {s.WRONG - 1}) AS inliers FROM m GROUP BY session)"""

#: What exact captures give.
_TRUTH = ", ".join([*(f"{round(x, 5) + 0.0}::DOUBLE AS r{i}" for i, x in enumerate(TRUE_R)), *(f"{round(x, 5)}::DOUBLE AS t{i}" for i, x in enumerate(TRUE_T)), *(f"{x}::DOUBLE AS offset{i}" for i, x in enumerate(PARAMS.offset))])
_Q = Rotation(np.array(TRUE_R).reshape(3, 3))
_BASELINE_OFF = abs(float(np.linalg.norm(TRUE_T)) - PARAMS.measured_baseline_m) > PARAMS.baseline_tol_m

ORACLES = {
    "condition_planarity": f"""WITH p AS (SELECT c_custkey AS session, sqrt(2) * (1 + c_custkey % 7) / 4 AS a, sqrt(2) * (1 + c_custkey % 5) / 3 AS b, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE sqrt(2) * (1 + c_custkey % 4) / 16 END AS c FROM customer),
        m AS (SELECT session, greatest(a, b, c) AS most, least(a, b, c) AS least FROM p)
        SELECT session, CASE WHEN least = 0 THEN 'Infinity'::DOUBLE ELSE {c.r('most / least')} END AS condition_number, least < greatest(1e-3, 0.02 * most) AS planar FROM m""",
    "rotation_mean_chordal": f"""SELECT c_custkey AS session, 5::BIGINT AS n, {c.r('cos(radians(c_custkey % 170))')} AS r0, {c.r('-sin(radians(c_custkey % 170))')} AS r1, 0.0::DOUBLE AS r2, {c.r('sin(radians(c_custkey % 170))')} AS r3,
        {c.r('cos(radians(c_custkey % 170))')} AS r4, 0.0::DOUBLE AS r5, 0.0::DOUBLE AS r6, 0.0::DOUBLE AS r7, 1.0::DOUBLE AS r8 FROM customer""",
    "solve_extrinsic": f"SELECT s_suppkey AS session, 'solved' AS status, {CAPTURES}::INTEGER AS n_captures, {CAPTURES}::INTEGER AS n_inliers, 0::INTEGER AS n_rejected, true AS elevation_used, true AS converged, {_TRUTH} FROM supplier",
    "solve_forced": "SELECT s_suppkey AS session, 'insufficient' AS status, 3::INTEGER AS n_captures, NULL::INTEGER AS n_inliers FROM supplier UNION ALL SELECT s_suppkey, 'solved', 4, 4 FROM supplier",
    "solve_noisy": f"""{_RIGS} SELECT session, CASE WHEN n >= 4 THEN 'solved' ELSE 'insufficient' END AS status, n AS n_captures, CASE WHEN n >= 4 THEN n - wrong END AS n_inliers, CASE WHEN n >= 4 THEN wrong END AS n_rejected,
        CASE WHEN n >= 4 THEN inliers ELSE '' END AS inliers, CASE WHEN n >= 4 THEN 9 END AS rank, {', '.join(f'CASE WHEN n >= 4 THEN true END AS {x}' for x in ('near_rotation', 'near_translation', 'near_offset', 'sure', 'fits'))} FROM k""",
    "loo_noisy": f"{_RIGS} SELECT session, (m + 1)::INTEGER AS fold, true AS fair FROM m JOIN k USING (session) WHERE m % {s.WRONG} <> {s.WRONG - 1} AND n - wrong >= 5",
    "loo_folds": f"SELECT s_suppkey AS session, fold::INTEGER AS fold, 0.0::DOUBLE AS sigma_error FROM supplier, range(1, {CAPTURES + 1}) AS f(fold)",
    "solve_end_to_end": f"""SELECT s_suppkey AS session, 'solved' AS status, {CAPTURES}::INTEGER AS n_inliers, 0::INTEGER AS n_rejected, {', '.join(f'0.0::DOUBLE AS {n}' for n in ('rms_mm', 'mean_3d_mm', 'worst_bias_mm', 'mean_px', 'loo_rms_sigma', 'loo_max_sigma', 'rms_sigma'))},
        '' AS weak, false AS low_diversity, false AS planar, true AS passes, {_BASELINE_OFF} AS warn_baseline, false AS warn_loo, false AS warn_condition FROM supplier""",
    "solution_document": f"""SELECT s_suppkey AS session, 'camera' AS parent_frame, 'measurement_space_ML_robust' AS method, {CAPTURES}::INTEGER AS n_captures, {CAPTURES}::INTEGER AS n_inliers, 0::INTEGER AS n_rejected, true AS verdict_pass, true AS elevation_used,
        true AS apex_offset_solved, '' AS weak, 0.0::DOUBLE AS mean_3d_mm, {PARAMS.sigma_az_deg}::DOUBLE AS radar_noise_sigma_az_deg, 1700000000000000000 AS stamp,
        {', '.join(f'{round(x, 4) + 0.0}::DOUBLE AS {n}{i}' for n, xs in (('t', TRUE_T), ('q', _Q.quaternion()), ('rpy', _Q.rpy_deg()), ('back', _Q.inverse_of(TRUE_T)), ('apex', PARAMS.offset)) for i, x in enumerate(xs))} FROM supplier""",
    "solve_report": f"SELECT s_suppkey AS session, 'session ' || s_suppkey || ': PASS, {CAPTURES} captures, 0 rejected, |t| {float(np.linalg.norm(TRUE_T)) * 1000:.1f} mm, 3-D 0.0 mm, bias 0.0 mm, residual 0.00 sigma, leave-one-out 0.00 sigma' AS line FROM supplier",
    "board_pose_fit": f"""WITH p AS (SELECT s_suppkey AS k, (s_suppkey % 7 - 3) / 10 AS a FROM supplier)
        SELECT k AS frame_id, {', '.join(f'{x} AS rb{i}' for i, x in enumerate([c.r('cos(a)', 5), '0.0::DOUBLE', c.r('sin(a)', 5), '0.0::DOUBLE', '1.0::DOUBLE', '0.0::DOUBLE', c.r('-sin(a)', 5), '0.0::DOUBLE', c.r('cos(a)', 5)]))},
        {c.r('(k % 5 - 2) / 20', 5)} AS tb0, {c.r('(k % 3 - 1) / 20', 5)} AS tb1, {c.r('1 + (k % 11) / 20', 5)} AS tb2, 0.0::DOUBLE AS reproj_l2_over_n, 48::INTEGER AS n_corners FROM p""",
    "board_pose_noisy": "SELECT s_suppkey AS frame_id, true AS near_rotation, true AS near_translation, true AS error_of_noise, 48::INTEGER AS n_corners FROM supplier",
    "centroid_crosscov": f"""WITH {_UNIT}, m AS (SELECT session, count(*) AS n, {', '.join(f'avg({p}) AS m_{p}' for p in (*_P, *_C))} FROM u GROUP BY session)
        SELECT session, n, {', '.join(f'{c.r(f"any_value(m_{p})", 5)} AS m_{p}' for p in _P)}, {', '.join(f'{c.r(f"any_value(m_{q})", 5)} AS m_q{q[1]}' for q in _C)},
        {', '.join(f'{c.r(f"sum(({p} - m_{p}) * ({q} - m_{q}))", 5)} AS h{i}{j}' for i, p in enumerate(_P) for j, q in enumerate(_C))} FROM u JOIN m USING (session) GROUP BY session, n""",
    "kabsch_fit": f"WITH {c.TRACKS} SELECT session, count(*) AS n, {', '.join(f'{x}::DOUBLE AS r{i}' for i, x in enumerate(c.R))}, {', '.join(f'{x}::DOUBLE AS t{i}' for i, x in enumerate(c.T))} FROM tracks GROUP BY session",
    "error_stats": _stats(_RES, "n rms_mm mean_3d_mm bias_x_mm bias_y_mm bias_z_mm worst_bias_mm"),
    "rms_bias": _stats("px - cx AS dx, py - cy AS dy, pz - cz AS dz", "rms_mm worst_bias_mm"),
    "pixel_error": f"""WITH {c.TRACKS}, u AS (
        SELECT session, round_even(500 * ((px + 0.01) / pz) + 480, 0) - round_even(500 * (cx / cz) + 480, 0) AS du, round_even(510 * (py / pz) + 270, 0) - round_even(510 * (cy / cz) + 270, 0) AS dv
        FROM tracks WHERE cz > 0.1 AND pz > 0.1) SELECT session, count(*) AS n_seen, {c.r('avg(sqrt(du * du + dv * dv))')} AS mean_px FROM u GROUP BY session""",
    "spread_guard": f"""WITH {c.TRACKS}, p AS (SELECT session, {_RANGE('p')} AS r, degrees(CASE WHEN {_RANGE('p')} < 1e-9 THEN 0 ELSE atan2(py, px) END) AS a,
        degrees(CASE WHEN {_RANGE('p')} < 1e-9 THEN 0 ELSE asin(greatest(-1, least(1, pz / {_RANGE('p')}))) END) AS l FROM tracks)
        SELECT session, {c.r('max(r) - min(r)')} AS range_span, {c.r('max(a) - min(a)')} AS az_span_deg, {c.r('max(l) - min(l)')} AS el_span_deg,
        max(r) - min(r) < 0.2 OR max(a) - min(a) < 20 AS low_diversity FROM p GROUP BY session""",
    "elevation_detect": f"WITH {c.TRACKS} {_elevation('abs(pz)', 'false')} UNION ALL {_elevation('pz', 'true')}",
    "range_fit": f"""WITH {c.TRACKS}, p AS (SELECT session, {_RANGE('p')} AS s, {_RANGE('c')} AS c FROM tracks),
        f AS (SELECT session, regr_slope(c, s) AS a, regr_intercept(c, s) AS b FROM p GROUP BY session HAVING count(*) >= 2)
        SELECT session, {c.r('a', 5)} AS a, {c.r('b', 5)} AS b, abs(a - 1) > 0.03 OR abs(b) > 0.05 AS report, {c.r('a * 1.01', 5)} AS new_scale, {c.r('a * 0.02 - b', 5)} AS new_bias FROM f WHERE a IS NOT NULL""",
    "scatter_sums": f"""WITH {_UNIT}, m AS (SELECT session, count(*) AS n, avg(px) AS m0, avg(py) AS m1, avg(pz) AS m2 FROM u GROUP BY session)
        SELECT session, n, {', '.join(f'{c.r(f"sum(({_P[i]} - m{i}) * ({_P[j]} - m{j}))", 5)} AS s{i}{j}' for i in range(3) for j in range(i, 3))} FROM u JOIN m USING (session) GROUP BY session, n""",
    "inlier_floor": """WITH w AS (SELECT user_id AS session, event_id AS id, value AS e, count(*) OVER s AS n, count(*) FILTER (value < 20) OVER s AS below,
            row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k FROM events WINDOW s AS (PARTITION BY user_id)),
        b AS (SELECT session, min(e) AS bound FROM w WHERE k = least(n, greatest(4, floor(n * 0.6))) GROUP BY session)
        SELECT session, id, e, CASE WHEN below < greatest(4, floor(n / 2)) THEN e <= bound ELSE e < 20 END AS inlier FROM w JOIN b USING (session)""",
    "fold_exclusion_join": f"""SELECT a.s_nationkey AS session, a.s_suppkey AS capture_no, count(*) AS n_train, {c.r('avg(b.s_acctbal)', 4)} AS mean_train
        FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY 1, 2""",
    "observability": f"WITH {_SIG} SELECT c_custkey, concat_ws(',', {', '.join(f'''CASE WHEN {w} THEN '{n}' END''' for w, n in [*_WEAK, ('o > 0.03', 'offset')])}) AS weak FROM sig",
    "verdict": f"""WITH {_SIG} SELECT c_custkey, c_custkey % 10 <> 0 AND bal / 20 <= 200 AND bal / 50 <= 150 AND bal / 100 <= 50 AND NOT ({' OR '.join(w for w, _ in _WEAK)}) AS passes FROM sig""",
    "warning_rules": f"""WITH {_SIG} SELECT c_custkey, abs(bal / 20000 - 0.35) > 0.03 AS warn_baseline, c_custkey % 4 > 0 AND c_custkey % 5 > 2.5 AS warn_loo, c_custkey % 2 <> 0 AND bal / 10 > 200 AS warn_condition FROM sig""",
    "min_corners_having": "SELECT l_orderkey AS frame_id, count(DISTINCT l_partkey % 48) AS n_corners FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey % 48) >= 6",
    "reproj_gate": f"""WITH e AS (SELECT l_orderkey AS frame_id, sqrt(sum(l_quantity * l_quantity)) / count(*) AS x, count(*)::INTEGER AS n_corners FROM lineitem GROUP BY 1)
        SELECT frame_id, {c.r('x')} AS reproj_l2_over_n, n_corners FROM e WHERE x <= 15""",
}

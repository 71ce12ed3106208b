"""Queries of the gates and of the selected return."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import gating as o
from plumbline.plans import common as c
from plumbline.plans.geometry import KEY
from plumbline.schemas import Params
from plumbline.sources import tables as s

PARAMS = Params()
_R = "sqrt(x * x + y * y + z * z)"
_K = ", ".join(KEY)


def _points(spark, d):
    return s.points(spark, d)


def _with_camera(spark, d):
    return _points(spark, d).join(s.camera(spark, d), "frame_id")


def _background(spark, d):
    """The first frames' points, pooled as after a command at the start."""
    return o.pooled_background(_points(spark, d), PARAMS.bg_accum_frames)


def _out(df):
    return c.rounded_all(df.select(*KEY, "x", "y", "z", "snr"), KEY)


def gate_range(spark, d):
    return _out(_points(spark, d).where(o.range_gate(0.5, 2.5)))


def gate_doppler(spark, d):
    return _out(_points(spark, d).where(o.doppler_gate(0.35, 0.15)))


def gate_camera_range(spark, d):
    return _out(_with_camera(spark, d).where(o.camera_range_gate(0.5)))


def gate_soft(spark, d):
    return _out(o.soft_gated(_with_camera(spark, d), 0.5))


def background_pool(spark, d):
    return _out(o.pooled_background(_points(spark, d), 15, after=100))


def background_anti_join(spark, d):
    return _out(o.without_background(_points(spark, d), _background(spark, d), 0.2))


def select_return(spark, d):
    return _out(o.selected_returns(_points(spark, d), s.camera(spark, d), _background(spark, d), PARAMS, tuple(KEY[1:])))


def select_nearest(spark, d):
    """Without strengths: nearest to the predicted point."""
    p = PARAMS.with_values(select_by="nearest", min_snr=0.0)
    return _out(o.selected_returns(_points(spark, d), s.camera(spark, d), None, p, tuple(KEY[1:])))


def gate_funnel(spark, d):
    return o.gate_funnel(_points(spark, d), s.camera(spark, d), _background(spark, d), PARAMS)


def background_stack(spark, d):
    """Two commands' frames, one under the other."""
    a = o.pooled_background(_points(spark, d), 5).withColumn("command", F.lit(1))
    b = o.pooled_background(_points(spark, d), 5, after=1000).withColumn("command", F.lit(2))
    return c.rounded_all(a.unionByName(b).select("command", *KEY, "x", "y", "z"), KEY)


QUERIES = {f.__name__: f for f in (gate_range, gate_doppler, gate_camera_range, gate_soft, background_pool, background_anti_join, select_return, select_nearest, gate_funnel, background_stack)}

_OUT = f"{_K}, {c.r('x')} AS x, {c.r('y')} AS y, {c.r('z')} AS z, {c.r('snr')} AS snr"
_CLEAR = "NOT EXISTS (SELECT 1 FROM background WHERE sqrt((x - bx) ** 2 + (y - by_) ** 2 + (z - bz) ** 2) <= 0.2)"
_NEAR = "sqrt((x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2)"
_ORDER = ", ".join(KEY[1:])

ORACLES = {
    "gate_range": f"WITH {c.POINTS} SELECT {_OUT} FROM points WHERE {_R} BETWEEN 0.5 AND 2.5",
    "gate_doppler": f"WITH {c.POINTS} SELECT {_OUT} FROM points WHERE abs(doppler) <= 0.35 AND abs(doppler) >= 0.15",
    "gate_camera_range": f"WITH {c.POINTS}, {c.CAMERA} SELECT {_OUT} FROM points JOIN camera USING (frame_id) WHERE abs({_R} - cam_range) <= 0.5",
    "gate_soft": f"""WITH {c.POINTS}, {c.CAMERA}, t AS (
        SELECT *, {_NEAR} <= 0.5 AS tight, bool_or({_NEAR} <= 0.5) OVER (PARTITION BY frame_id) AS any_tight FROM points JOIN camera USING (frame_id))
        SELECT {_OUT} FROM t WHERE tight OR NOT any_tight""",
    "background_pool": f"WITH {c.POINTS} SELECT {_OUT} FROM points WHERE frame_id IN (SELECT DISTINCT frame_id FROM points WHERE frame_id > 100 ORDER BY frame_id LIMIT 15)",
    "background_anti_join": f"WITH {c.POINTS}, {c.BACKGROUND} SELECT {_OUT} FROM points WHERE {_CLEAR}",
    "select_return": f"""WITH {c.POINTS}, {c.BACKGROUND}, {c.CAMERA},
        g AS (SELECT p.*, px, py, pz FROM points p JOIN camera USING (frame_id) WHERE {_R} BETWEEN 0.5 AND 2.5 AND {_CLEAR} AND abs({_R} - cam_range) <= 0.5),
        t AS (SELECT *, {_NEAR} <= 0.5 AS tight, bool_or({_NEAR} <= 0.5) OVER (PARTITION BY frame_id) AS any_tight FROM g),
        k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY snr DESC, {_ORDER}) AS rank FROM t WHERE tight OR NOT any_tight)
        SELECT {_OUT} FROM k WHERE rank = 1 AND snr >= 100""",
    "select_nearest": f"""WITH {c.POINTS}, {c.CAMERA},
        g AS (SELECT p.*, px, py, pz FROM points p JOIN camera USING (frame_id) WHERE {_R} BETWEEN 0.5 AND 2.5 AND abs({_R} - cam_range) <= 0.5),
        t AS (SELECT *, {_NEAR} AS far, bool_or({_NEAR} <= 0.5) OVER (PARTITION BY frame_id) AS any_tight FROM g),
        k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY far, {_ORDER}) AS rank FROM t WHERE far <= 0.5 OR NOT any_tight)
        SELECT {_OUT} FROM k WHERE rank = 1""",
    "gate_funnel": f"""WITH {c.POINTS}, {c.BACKGROUND}, {c.CAMERA},
        f AS (SELECT frame_id, {_R} BETWEEN 0.5 AND 2.5 AS a, {_CLEAR} AS b, abs({_R} - cam_range) <= 0.5 AS c, {_NEAR} <= 0.5 AS d FROM points JOIN camera USING (frame_id)),
        n AS (SELECT frame_id, count(*) AS n_raw, count(*) FILTER (a) AS n_range, count(*) FILTER (a AND b) AS n_background,
                     count(*) FILTER (a AND b AND c) AS n_camera, count(*) FILTER (a AND b AND c AND d) AS n_tight FROM f GROUP BY frame_id)
        SELECT frame_id, n_raw, n_range, n_background, n_camera, CASE WHEN n_tight > 0 THEN n_tight ELSE n_camera END AS n_soft FROM n""",
    "background_stack": f"""WITH {c.POINTS}
        SELECT 1 AS command, {_K}, {c.r('x')} AS x, {c.r('y')} AS y, {c.r('z')} AS z FROM points WHERE frame_id IN (SELECT DISTINCT frame_id FROM points ORDER BY frame_id LIMIT 5)
        UNION ALL
        SELECT 2, {_K}, {c.r('x')}, {c.r('y')}, {c.r('z')} FROM points WHERE frame_id IN (SELECT DISTINCT frame_id FROM points WHERE frame_id > 1000 ORDER BY frame_id LIMIT 5)""",
}

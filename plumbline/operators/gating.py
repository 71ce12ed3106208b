"""Gates on detections, background rejection and the choice of one return for each frame.

Detections have frame_id, x, y, z, snr, doppler and columns that order ties.
Plain gates are filters that Catalyst may reorder. The soft gate, the choice and
the gate on the chosen return are not: each looks at what the ones before left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import geometry as g
from plumbline.schemas import Params


def xyz() -> list[Column]:
    return g.vec("x", "y", "z")


def predicted() -> list[Column]:
    return g.vec("px", "py", "pz")


def range_gate(low: float, high: float) -> Column:
    return g.norm(xyz()).between(low, high)


def doppler_gate(most: float, least: float) -> Column:
    """|doppler| <= most and >= least; a limit of 0 or less is off."""
    gate = F.lit(True)
    if most > 0:
        gate &= F.abs("doppler") <= most
    if least > 0:
        gate &= F.abs("doppler") >= least
    return gate


def camera_range_gate(margin: float) -> Column:
    """Range from the sensor within ``margin`` of the target's range from the camera.

    The two origins differ, so the margin must exceed their distance. Without a
    camera range, or with a margin of 0 or less, everything passes.
    """
    if margin <= 0:
        return F.lit(True)
    return F.col("cam_range").isNull() | (F.abs(g.norm(xyz()) - F.col("cam_range")) <= margin)


_CELL = ("nx", "ny", "nz")


def _cell(c: Column, dist: float) -> Column:
    return F.floor(c / dist).cast("long")


def _near_background(background: DataFrame, dist: float) -> DataFrame:
    """Distinct background points bx, by, bz in their own and the 26 neighbouring cells of size ``dist``."""
    near = background.select("x", "y", "z").distinct().select(*[F.col(c).alias(f"b{c}") for c in "xyz"])
    for c in "xyz":
        near = near.withColumn(f"n{c}", F.explode(F.sequence(_cell(F.col(f"b{c}"), dist) - 1, _cell(F.col(f"b{c}"), dist) + 1)))
    return near


def without_background(points: DataFrame, background: DataFrame, dist: float) -> DataFrame:
    """Points farther than ``dist`` from every background point.

    Space is cut into cells of that size; a background point goes to its own and
    the 26 neighbouring cells, so the anti-join has an equality key and compares
    points of one neighbourhood only. Background points that share a cell and a
    place are one.
    """
    near = _near_background(background, dist)
    placed = points.withColumns({n: _cell(F.col(c), dist) for n, c in zip(_CELL, "xyz", strict=True)})
    same = (placed["nx"] == near["nx"]) & (placed["ny"] == near["ny"]) & (placed["nz"] == near["nz"])
    return placed.join(near, same & (g.distance(xyz(), g.vec("bx", "by", "bz")) <= dist), "left_anti").drop(*_CELL)


def marked_background(points: DataFrame, background: DataFrame, dist: float) -> DataFrame:
    """``points`` with ``matched``: whether a background point is within ``dist``.

    A cell's background points are one array, so the points are joined once and keep
    their number.
    """
    near = _near_background(background, dist).groupBy(*_CELL).agg(F.collect_list(F.struct("bx", "by", "bz")).alias("around"))
    placed = points.withColumns({n: _cell(F.col(c), dist) for n, c in zip(_CELL, "xyz", strict=True)}).join(near, list(_CELL), "left")
    close = F.exists("around", lambda b: g.distance(xyz(), [b["bx"], b["by"], b["bz"]]) <= dist)
    return placed.withColumn("matched", F.coalesce(close, F.lit(False))).drop(*_CELL, "around")


def soft_gated(points: DataFrame, radius: float) -> DataFrame:
    """Points within ``radius`` of the predicted one; all of a frame's where none is, or none is predicted."""
    tight = F.coalesce(g.distance(xyz(), predicted()) <= radius, F.lit(False))
    frame = Window.partitionBy("frame_id")
    rows = points.withColumn("tight", tight).withColumn("any_tight", F.max("tight").over(frame))
    return rows.where("tight or not any_tight").drop("tight", "any_tight")


def chosen(points: DataFrame, ties: tuple[str, ...], select_by: str = "snr") -> DataFrame:
    """One return for each frame: the strongest where any is positive and that is asked for,
    else the nearest to the predicted point, else the nearest to the sensor; first of equal ones.

    One aggregation: the best row by strength and the best by distance side by side.
    """
    row = F.struct(*points.columns)
    far = F.coalesce(g.distance(xyz(), predicted()), g.norm(xyz())) if "px" in points.columns else g.norm(xyz())
    best = [F.min_by(row, F.struct(far.alias("cost"), *ties)).alias("near")]
    if select_by != "snr":
        return points.groupBy("frame_id").agg(*best).select("near.*")
    best += [F.min_by(row, F.struct((-F.col("snr")).alias("cost"), *ties)).alias("strong"), F.max("snr").alias("most")]
    return points.groupBy("frame_id").agg(*best).select(F.when(F.col("most") > 0, F.col("strong")).otherwise(F.col("near")).alias("row")).select("row.*")


def selected_returns(points: DataFrame, camera: DataFrame, background: DataFrame | None, p: Params, ties: tuple[str, ...]) -> DataFrame:
    """Every frame's return that passes all gates."""
    rows = points.where(range_gate(p.min_range, p.max_range) & doppler_gate(p.max_abs_doppler, p.min_abs_doppler))
    if background is not None:
        rows = without_background(rows, background, p.bg_match_dist)
    rows = rows.join(camera, "frame_id").where(camera_range_gate(p.range_gate_margin_m))
    rows = chosen(soft_gated(rows, p.gate_radius), ties, p.select_by)
    return rows.where(F.col("snr") >= p.min_snr) if p.min_snr > 0 else rows


def gate_funnel(points: DataFrame, camera: DataFrame, background: DataFrame, p: Params) -> DataFrame:
    """(frame_id, n_raw, n_range, n_background, n_camera, n_soft): how many of each frame's points are left after each gate."""
    rows = points.withColumn("in_range", range_gate(p.min_range, p.max_range) & doppler_gate(p.max_abs_doppler, p.min_abs_doppler))
    rows = marked_background(rows, background, p.bg_match_dist).join(camera, "frame_id")
    rows = rows.withColumn("clear", F.col("in_range") & ~F.col("matched"))
    near = F.col("clear") & camera_range_gate(p.range_gate_margin_m)
    rows = rows.withColumn("near", F.coalesce(near, F.lit(False))).withColumn("tight", F.col("near") & (g.distance(xyz(), predicted()) <= p.gate_radius))
    counts = [F.count_if(c).alias(n) for c, n in (("in_range", "n_range"), ("clear", "n_background"), ("near", "n_camera"), ("tight", "n_tight"))]
    out = rows.groupBy("frame_id").agg(F.count("*").alias("n_raw"), *counts)
    return out.withColumn("n_soft", F.when(F.col("n_tight") > 0, F.col("n_tight")).otherwise(F.col("n_camera"))).drop("n_tight")


def background_ready(clouds: DataFrame, commands: DataFrame, frames: int) -> DataFrame:
    """(ready_us): the stamp at which the first command's background is whole, that of the
    ``frames``-th non-empty cloud at or after it; no row where it never is."""
    begun = commands.agg(F.min("stamp_us").alias("begun_us"))
    later = clouds.crossJoin(F.broadcast(begun)).where("stamp_us >= begun_us")  # one row
    first = later.select("stamp_us").orderBy("stamp_us").limit(frames)
    return first.agg(F.max("stamp_us").alias("ready_us"), F.count("*").alias("n")).where(F.col("n") == frames).select("ready_us")


def pooled_background(points: DataFrame, frames: int, after: int = -1) -> DataFrame:
    """Points of the first ``frames`` non-empty frames after a command at frame ``after``.

    The frames are found from distinct ids by a bounded sort, so the points are
    only filtered.
    """
    ids = points.where(F.col("frame_id") > after).select("frame_id").distinct().orderBy("frame_id").limit(frames)
    return points.join(ids, "frame_id", "left_semi")

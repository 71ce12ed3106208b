"""Checks of an extrinsic: errors, biases, spread of the points, observability and the verdict."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.schemas import Params


def sensed() -> list[Column]:
    return g.vec("px", "py", "pz")


def seen() -> list[Column]:
    return g.vec("cx", "cy", "cz")


def with_residuals(pairs: DataFrame, r: g.Mat, t: g.Vec) -> DataFrame:
    """dx, dy, dz: sensor point in the camera less the camera's own."""
    return pairs.withColumns(dict(zip(("dx", "dy", "dz"), g.minus(g.rigid(r, t, sensed()), seen()), strict=True)))


def error_stats(residuals: DataFrame) -> DataFrame:
    """(session, n, rms_mm, mean_3d_mm, bias_x_mm, bias_y_mm, bias_z_mm, worst_bias_mm)."""
    size2 = g.dot(g.vec("dx", "dy", "dz"), g.vec("dx", "dy", "dz"))
    bias = [F.avg(c) * 1000 for c in ("dx", "dy", "dz")]
    return residuals.groupBy("session").agg(
        F.count("*").alias("n"), (F.sqrt(F.avg(size2)) * 1000).alias("rms_mm"), (F.avg(F.sqrt(size2)) * 1000).alias("mean_3d_mm"),
        *[b.alias(f"bias_{c}_mm") for b, c in zip(bias, "xyz", strict=True)], F.greatest(*[F.abs(b) for b in bias]).alias("worst_bias_mm"),
    )


def pixel_errors(pairs: DataFrame, r: g.Mat, t: g.Vec, k: g.Mat, d: g.Vec) -> DataFrame:
    """(session, n_seen, mean_px) over pairs of which both points are ahead of the camera; NaN where none is."""
    (u1, v1), (u2, v2) = g.projected(g.rigid(r, t, sensed()), k, d), g.projected(seen(), k, d)
    error = F.sqrt(((u1 - u2) * (u1 - u2) + (v1 - v2) * (v1 - v2)).cast("double"))
    return pairs.withColumn("px_error", error).groupBy("session").agg(F.count("px_error").alias("n_seen"), F.coalesce(F.avg("px_error"), F.lit(float("nan"))).alias("mean_px"))


def spread(pairs: DataFrame) -> DataFrame:
    """(session, range_span, az_span_deg, el_span_deg, low_diversity); azimuth isn't taken around the back."""
    r, az, el = g.spherical(sensed())
    rows = pairs.select("session", r.alias("r"), F.degrees(az).alias("az"), F.degrees(el).alias("el"))
    out = rows.groupBy("session").agg(*[(F.max(c) - F.min(c)).alias(n) for c, n in (("r", "range_span"), ("az", "az_span_deg"), ("el", "el_span_deg"))])
    return out.withColumn("low_diversity", (F.col("range_span") < 0.20) | (F.col("az_span_deg") < 20))


def elevation_spread(pairs: DataFrame, signed: bool = False) -> DataFrame:
    """(session, el_spread, uses_elevation)."""
    z = sensed()[2] if signed else F.abs(sensed()[2])
    out = pairs.groupBy("session").agg(F.stddev_pop(z / F.greatest(g.norm(sensed()), F.lit(1e-6))).alias("el_spread"))
    return out.withColumn("uses_elevation", F.col("el_spread") > 0.01)


def range_fit(pairs: DataFrame, params: Params) -> DataFrame:
    """(session, a, b, report, new_scale, new_bias): camera range as a * sensor range + b.

    The new correction composes the fit with the one already applied: scale a * scale,
    bias a * bias - b.
    """
    rows = pairs.select("session", g.norm(sensed()).alias("s"), g.norm(seen()).alias("c"))
    out = rows.groupBy("session").agg(F.count("*").alias("n"), F.regr_slope("c", "s").alias("a"), F.regr_intercept("c", "s").alias("b")).where("n >= 2 and a is not null").drop("n")
    hint = {"report": (F.abs(F.col("a") - 1) > 0.03) | (F.abs("b") > 0.05), "new_scale": F.col("a") * params.range_scale, "new_bias": F.col("a") * params.range_bias_m - F.col("b")}
    return out.withColumns(hint)


def scatter(pairs: DataFrame) -> DataFrame:
    """(session, n, s00, s01, s02, s11, s12, s22): centred second moments of the sensor points."""
    means = pairs.groupBy("session").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(("px", "py", "pz"))])
    d = [sensed()[i] - F.col(f"m{i}") for i in range(3)]
    sums = [F.sum(d[i] * d[j]).alias(f"s{i}{j}") for i in range(3) for j in range(i, 3)]
    return pairs.join(means, "session").groupBy("session", "n").agg(*sums)


def condition(pairs: DataFrame) -> DataFrame:
    """(session, condition_number, planar) from the scatter's eigenvalues; fewer than 3 points: infinite."""
    rows = scatter(pairs)
    kind = rows.schema["session"].dataType.simpleString()

    def solve(batches):
        for b in batches:
            m = b[["s00", "s01", "s02", "s01", "s11", "s12", "s02", "s12", "s22"]].to_numpy().reshape(-1, 3, 3)
            root = np.sqrt(np.clip(np.linalg.eigvalsh(m), 0, None))
            with np.errstate(divide="ignore", invalid="ignore"):
                cond = np.where((b.n < 3) | (root[:, 0] == 0), np.inf, root[:, 2] / root[:, 0])
            yield pd.DataFrame({"session": b.session, "condition_number": cond, "planar": root[:, 0] < np.maximum(1e-3, 0.02 * root[:, 2])})

    return rows.mapInPandas(solve, f"session {kind}, condition_number double, planar boolean")


def weak_freedoms(sigma: Column, offset_sigma: Column | None = None) -> Column:
    """Names of unobservable degrees of freedom: over 0.3 rad or 0.2 m; the offset over 30 mm."""
    limits = [("rot_x", 0.3), ("rot_y", 0.3), ("rot_z", 0.3), ("t_x", 0.2), ("t_y", 0.2), ("t_z", 0.2)]
    weak = [F.when(F.get(sigma, F.lit(i)) > limit, F.lit(name)) for i, (name, limit) in enumerate(limits)]
    if offset_sigma is not None:
        weak.append(F.when(F.coalesce(F.array_max(offset_sigma), F.lit(0.0)) > 0.03, F.lit("offset")))
    return F.array_compact(F.array(*weak))


def verdict(mean_px: Column, mean_3d_mm: Column, worst_bias_mm: Column, n_weak: Column, p: Params) -> Column:
    """Three limits, and nothing weak. NaN fails."""
    holds = lambda v, limit: ~F.isnan(v) & (v <= limit)
    return F.coalesce(holds(mean_px, p.pass_reproj_px) & holds(mean_3d_mm, p.pass_3d_mm) & holds(worst_bias_mm, p.pass_bias_mm) & (n_weak == 0), F.lit(False))


def warnings(t_norm: Column, loo: Column, cond: Column, planar: Column, p: Params) -> dict[str, Column]:
    """Rules that warn without failing."""
    off = F.abs(t_norm - p.measured_baseline_m) > p.baseline_tol_m if p.measured_baseline_m > 0 else F.lit(False)
    return {"warn_baseline": off, "warn_loo": F.coalesce(loo > 2.5, F.lit(False)), "warn_condition": ~planar & (cond > 200)}


def inlier_floor(errors: DataFrame, limit: float) -> DataFrame:
    """(session, id, e, inlier): errors below the limit; where fewer than max(4, half) are, those up to
    the max(4, 0.6 n)-th smallest, ties included."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("session")
    n = F.count("*").over(w)
    below = F.count_if(F.col("e") < limit).over(w)
    keep = F.least(n, F.greatest(F.lit(4), F.floor(n * 0.6)))
    rows = errors.withColumns({"n": n, "below": below, "keep": keep, "at": F.row_number().over(w.orderBy("e", "id"))})
    rows = rows.withColumn("bound", F.max(F.when(F.col("at") == F.col("keep"), F.col("e"))).over(w))
    short = F.col("below") < F.greatest(F.lit(4), F.floor(F.col("n") / 2))
    return rows.select("session", "id", "e", F.when(short, F.col("e") <= F.col("bound")).otherwise(F.col("e") < limit).alias("inlier"))

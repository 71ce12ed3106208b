"""Synthetic calibration scenes of known truth, made by Spark tasks from seeds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import batched
from plumbline.operators.estimate import euler_rotation, rotation
from plumbline.schemas import Params

SCENE = "session long, capture_no int, p array<double>, rb array<double>, tb array<double>, outlier boolean"


def truth(params: Params = Params()) -> tuple[np.ndarray, np.ndarray]:
    """The scenes' extrinsic: a few degrees and centimetres off the prior."""
    return euler_rotation(params.prior_rpy_deg) @ rotation(np.array([0.03, -0.05, 0.04])), np.asarray(params.prior_t) + [0.01, -0.015, 0.02]


def capture_scene(
    sessions: DataFrame, n: int = 20, noise: float = 1.0, outliers: float = 0.0, offset_error: float = 0.0, params: Params = Params(), elevation_deg: float = 15.0, azimuth_deg: float = 50.0
) -> DataFrame:
    """(session, capture_no, p, rb, tb, outlier) for each session of ``sessions`` (a column of numbers,
    which are the seeds): targets at 0.5 to 2.5 m, tilted up to 45 degrees.

    ``noise`` scales the parameters' sigmas; ``offset_error`` moves the true offset
    from the parameters' along x.
    """
    r, t = truth(params)
    sigma = noise * np.array([params.sigma_range_m, np.radians(params.sigma_az_deg), np.radians(params.sigma_el_deg)])
    offset = np.asarray(params.offset) + [offset_error, 0, 0]

    def numbers(session):
        """A session's random numbers, in the order in which its captures take them: where it is, axis and size of its tilt, whether it is wild, its noise or wild reading."""
        rng = np.random.default_rng(session)
        where, axis, tilt, noisy, at = np.empty((n, 3)), np.empty((n, 3)), np.empty((n, 2)), np.zeros((n, 3)), np.zeros((n, 3))
        for k in range(n):
            rng.random(out=where[k])
            rng.standard_normal(out=axis[k])
            rng.random(out=tilt[k])
            if tilt[k, 1] < outliers:
                rng.random(out=at[k])
            else:
                rng.standard_normal(out=noisy[k])
        return where, axis, tilt, noisy, at

    def between(u, low, high):
        return low + (high - low) * u

    def points(raz):
        far, az, el = np.moveaxis(raz, -1, 0)
        return np.stack([far * np.cos(el) * np.cos(az), far * np.cos(el) * np.sin(az), far * np.sin(el)], axis=-1)

    reach = np.array([azimuth_deg, elevation_deg])

    def make(batches):
        for some in (batch.session[at : at + 500] for batch in batches for at in range(0, len(batch), 500)):
            where, axis, tilt, noisy, at = (np.concatenate(x) for x in zip(*[numbers(int(session)) for session in some], strict=True))
            raz = np.column_stack([between(where[:, 0], 0.5, 2.5), np.radians(between(where[:, 1:], -reach, reach))])
            rb = batched.rotations(axis / np.linalg.norm(axis, axis=1)[:, None] * np.radians(between(tilt[:, :1], 0, 45)))
            tb = points(raz) @ r.T + t - rb @ offset
            wild = tilt[:, 1] < outliers
            seen = points(np.where(wild[:, None], np.column_stack([between(at[:, 0], 0.5, 2.5), between(at[:, 1:], -1, 1)]), raz + sigma * noisy))
            columns = {"session": np.repeat(some.to_numpy(), n), "capture_no": np.tile(np.arange(1, n + 1), len(some)), "p": list(seen), "rb": list(rb.reshape(-1, 9)), "tb": list(tb), "outlier": wild}
            yield pd.DataFrame(columns)

    # a session is a few bytes and makes captures for milliseconds: a small file's one part would be one task's
    parts = max(int(sessions.sparkSession.conf.get("spark.sql.shuffle.partitions")), sessions.sparkSession.sparkContext.defaultParallelism)
    return sessions.select(F.col("session").cast("long")).repartition(parts, "session").mapInPandas(make, SCENE)


def corner_scene(poses: DataFrame, board: list[tuple[float, float, float]], k: list[float], d: list[float], noise_px: float = 0.0) -> DataFrame:
    """(frame_id, corner_id, u, v): a board's corners as seen at poses (frame_id, vx, vy, vz, tx, ty, tz), rotation vector and translation."""
    points, camera, bend = np.array(board), np.array(k).reshape(3, 3), np.array(d)

    def make(batches):
        from plumbline.operators.posefit import project

        for some in (batch[at : at + 500] for batch in batches for at in range(0, len(batch), 500)):
            out = []
            for frame, *pose in some[["frame_id", "vx", "vy", "vz", "tx", "ty", "tz"]].itertuples(index=False):
                uv = project(points, np.array(pose[:3]), np.array(pose[3:]), camera, bend)
                uv = uv + np.random.default_rng(int(frame)).normal(size=uv.shape) * noise_px
                out += [(frame, i, *x) for i, x in enumerate(uv)]
            yield pd.DataFrame(out, columns=["frame_id", "corner_id", "u", "v"])

    return poses.mapInPandas(make, "frame_id long, corner_id int, u double, v double")

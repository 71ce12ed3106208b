"""Target poses from the corners a camera sees: a plane's homography, refined by reprojection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.operators import batched
from plumbline.operators.estimate import rotation


def project(points: np.ndarray, v: np.ndarray, t: np.ndarray, k: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Pixels of points turned by v and moved by t, through a pinhole with k1 k2 p1 p2 k3."""
    c = points @ rotation(v).T + t
    x, y = c[:, 0] / c[:, 2], c[:, 1] / c[:, 2]
    r2 = x * x + y * y
    radial = 1 + r2 * (d[0] + r2 * (d[1] + r2 * d[4]))
    xd = x * radial + 2 * d[2] * x * y + d[3] * (r2 + 2 * x * x)
    yd = y * radial + d[2] * (r2 + 2 * y * y) + 2 * d[3] * x * y
    return np.stack([k[0, 0] * xd + k[0, 2], k[1, 1] * yd + k[1, 2]], axis=1)


#: Frames that are fitted together: a task holds about 60 kB for each. Most steps of a fit; damping at which it gives up.
TOGETHER, STEPS, STUCK = 1000, 100, 1e12


def _pixels(points: np.ndarray, x: np.ndarray, k: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(G, N, 2) pixels of points (G, N, 3) at poses x (G, 6), and their derivatives by the pose (G, N, 2, 6)."""
    turned = points @ np.swapaxes(batched.rotations(x[:, :3]), 1, 2)
    c = turned + x[:, None, 3:]
    a, b = c[..., 0] / c[..., 2], c[..., 1] / c[..., 2]
    r2 = a * a + b * b
    radial, rise = 1 + r2 * (d[0] + r2 * (d[1] + r2 * d[4])), 2 * (d[0] + r2 * (2 * d[1] + r2 * 3 * d[4]))
    seen = np.stack([k[0, 0] * (a * radial + 2 * d[2] * a * b + d[3] * (r2 + 2 * a * a)) + k[0, 2], k[1, 1] * (b * radial + d[2] * (r2 + 2 * b * b) + 2 * d[3] * a * b) + k[1, 2]], axis=-1)
    mixed = a * b * rise + 2 * d[2] * a + 2 * d[3] * b
    by_a = np.stack([k[0, 0] * (radial + a * a * rise + 2 * d[2] * b + 6 * d[3] * a), k[1, 1] * mixed], axis=-1) / c[..., 2:]
    by_b = np.stack([k[0, 0] * mixed, k[1, 1] * (radial + b * b * rise + 6 * d[2] * b + 2 * d[3] * a)], axis=-1) / c[..., 2:]
    by_point = np.stack([by_a, by_b, -(by_a * a[..., None] + by_b * b[..., None])], axis=-1)
    return seen, np.concatenate([-by_point @ batched.skew(turned) @ batched.turn_of_change(x[:, :3])[:, None], by_point], axis=-1)


def _from_homographies(board: np.ndarray, pixels: np.ndarray, there: np.ndarray, k: np.ndarray) -> np.ndarray:
    """(G, 6) poses by the plane's homography, without distortion."""
    u, v = (pixels[..., 0] - k[0, 2]) / k[0, 0], (pixels[..., 1] - k[1, 2]) / k[1, 1]
    size = np.sqrt((board[..., :2] ** 2).sum(axis=2).max(axis=1))[:, None]
    bx, by, one, zero = board[..., 0] / size, board[..., 1] / size, np.ones_like(u), np.zeros_like(u)
    rows = np.concatenate([np.stack([bx, by, one, zero, zero, zero, -u * bx, -u * by, -u], -1) * there[..., None], np.stack([zero, zero, zero, bx, by, one, -v * bx, -v * by, -v], -1) * there[..., None]], axis=1)
    h = np.linalg.eigh(np.swapaxes(rows, 1, 2) @ rows)[1][..., 0].reshape(-1, 3, 3)
    h[..., :2] /= size[..., None]
    h = h / np.sqrt(np.linalg.norm(h[..., 0], axis=1) * np.linalg.norm(h[..., 1], axis=1))[:, None, None] * np.where(h[:, 2, 2] > 0, 1, -1)[:, None, None]
    return np.concatenate([batched.rotation_vectors(np.stack([h[..., 0], h[..., 1], np.cross(h[..., 0], h[..., 1])], axis=2)), h[..., 2]], axis=1)


def _mirrored(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The pose that looks alike from far: tilted to the other side of the line of sight to the board's centre."""
    turn = batched.rotations(x[:, :3])
    middle = (turn @ centre[..., None])[..., 0] + x[:, 3:]
    sight = middle / np.linalg.norm(middle, axis=1, keepdims=True)
    flip = np.eye(3) - 2 * sight[:, :, None] * sight[:, None, :]
    other = flip @ turn @ np.diag([1.0, 1.0, -1.0])
    return np.concatenate([batched.rotation_vectors(other), middle - (other @ centre[..., None])[..., 0]], axis=1)


def _refined(x: np.ndarray, board: np.ndarray, pixels: np.ndarray, there: np.ndarray, k: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Poses (G, 6) of least pixel error near x by damped steps, each frame with its own damping, and the errors' sums of squares."""

    def errors(x, some):
        seen, slopes = _pixels(board[some], x, k, d)
        f = ((seen - pixels[some]) * there[some][..., None]).reshape(len(x), -1)
        j = (slopes * there[some][..., None, None]).reshape(len(x), -1, 6)
        good = np.isfinite(f).all(axis=1) & np.isfinite(j).all(axis=(1, 2))
        return np.where(good[:, None], f, 0), np.where(good[:, None, None], j, 0), np.where(good, (f * f).sum(axis=1), np.inf)

    x, damp, busy = x.copy(), np.full(len(x), 1e-3), np.arange(len(x))
    f, j, cost = errors(x, busy)
    for _ in range(STEPS):
        jt = np.swapaxes(j[busy], 1, 2)
        normal = jt @ j[busy]
        diagonal = np.einsum("gii->gi", normal)
        step = -np.linalg.solve(normal + (damp[busy][:, None] * diagonal + 1e-12)[:, :, None] * np.eye(6), jt @ f[busy][..., None])[..., 0]
        moved = x[busy] + step
        f_new, j_new, cost_new = errors(moved, busy)
        better = cost_new <= cost[busy]
        small = (np.linalg.norm(step, axis=1) < 1e-12) | (cost[busy] - cost_new <= 1e-13 * cost[busy])
        won = busy[better]
        x[won], f[won], j[won], cost[won] = moved[better], f_new[better], j_new[better], cost_new[better]
        damp[busy] = np.where(better, damp[busy] / 10, damp[busy] * 10)
        busy = busy[~(better & small) & (damp[busy] <= STUCK)]
        if not len(busy):
            break
    return x, cost


def fit_poses(board: np.ndarray, pixels: np.ndarray, there: np.ndarray, k: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotation vectors, translations, ||pixel error|| / corners) of a flat board (z = 0) in G frames: (G, N, 3), (G, N, 2), (G, N).

    A flat board's pixel error may have two minima, tilts to either side of the line of sight;
    both are sought, and the lower one is the pose.
    """
    n = there.sum(axis=1)
    x, cost = _refined(_from_homographies(board, pixels, there, k), board, pixels, there, k, d)
    centre = (board * there[..., None]).sum(axis=1) / n[:, None]
    other, cost_other = _refined(_mirrored(x, centre), board, pixels, there, k, d)
    ahead = (batched.rotations(other[:, :3]) @ centre[..., None])[:, 2, 0] + other[:, 5] > 0
    lower = ahead & (cost_other < cost)
    x, cost = np.where(lower[:, None], other, x), np.where(lower, cost_other, cost)
    return x[:, :3], x[:, 3:], np.sqrt(cost) / n


def fit_pose(board: np.ndarray, pixels: np.ndarray, k: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The same of one frame."""
    v, t, error = fit_poses(board[None], pixels[None], np.ones((1, len(board)), bool), k, d)
    return v[0], t[0], float(error[0])


def enough_corners(corners: DataFrame, least: int) -> DataFrame:
    """(frame_id, n_corners) of frames with at least ``least`` distinct corners."""
    return corners.groupBy("frame_id").agg(F.count_distinct("corner_id").alias("n_corners")).where(F.col("n_corners") >= least)


def board_poses(corners: DataFrame, board: DataFrame, k: list[float], d: list[float], least: int, max_error: float) -> DataFrame:
    """(frame_id, rb, tb, reproj_l2_over_n, n_corners) of frames with enough corners and a small error.

    A frame has at most as many corners as the board, which bounds a group.
    """
    camera, bend = np.array(k, float).reshape(3, 3), np.array(list(d) or [0.0] * 5, float)
    once = corners.repartition("frame_id").dropDuplicates(["frame_id", "corner_id"])  # dealt by frame alone, so the frames are whole already
    seen = once.join(F.broadcast(board), "corner_id")  # board: its own few corners
    frames = seen.groupBy("frame_id").agg(F.collect_list(F.struct(*[F.col(n).cast("double").alias(n) for n in ("x", "y", "z", "u", "v")])).alias("corners")).where(F.size("corners") >= least)
    struct = T.StructType.fromDDL("frame_id long, rb array<double>, tb array<double>, reproj_l2_over_n double, n_corners int")
    arrow = to_arrow_schema(struct)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                b = batch.slice(at, TOGETHER)
                flat, sizes = b.column("corners").flatten(), b.column("corners").value_lengths().to_numpy()
                there = np.arange(sizes.max()) < sizes[:, None]
                numbers = np.zeros((*there.shape, 5))
                numbers[there] = np.stack([flat.field(i).to_numpy() for i in range(5)], axis=1)
                v, t, error = fit_poses(numbers[..., :3], numbers[..., 3:], there, camera, bend)
                columns = [b.column("frame_id"), list(batched.rotations(v).reshape(-1, 9)), list(t), error, sizes]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else pa.array(c).cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return frames.mapInArrow(run, struct).where(F.col("reproj_l2_over_n") <= max_error)

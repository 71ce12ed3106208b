"""Extrinsic estimation between two sensors, one group of captures (session, fold or bootstrap) at a time.

Sums and joins run in Spark; what is left per group, tens of captures, is solved in
numpy by ``batched``, thousands of groups at once.

Captures have session, capture_no, p (sensor point, 3), rb (target rotation, 9 in
row order) and tb (target translation, 3). The unknowns are the rotation vector and
translation of sensor to camera, and, if asked for, the offset in the target's frame.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.operators import batched
from plumbline.schemas import Params

# ---- rotations ------------------------------------------------------------------------------


def rotation(v: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(v)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    if angle < 1e-8:
        return np.eye(3) + k + k @ k / 2
    return np.eye(3) + np.sin(angle) / angle * k + (1 - np.cos(angle)) / angle**2 * (k @ k)


def rotvec(m: np.ndarray) -> np.ndarray:
    w, q = np.linalg.eigh(_davenport(m))
    x = q[:, -1] * (1 if q[3, -1] >= 0 else -1)
    size = np.linalg.norm(x[:3])
    return 2 * x[:3] if size < 1e-12 else x[:3] / size * 2 * np.arctan2(size, x[3])


def _davenport(m: np.ndarray) -> np.ndarray:
    """Symmetric 4x4 whose top eigenvector is the quaternion x, y, z, w nearest to a matrix."""
    out = np.empty((4, 4))
    out[:3, :3] = m + m.T - np.trace(m) * np.eye(3)
    out[:3, 3] = out[3, :3] = [m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]]
    out[3, 3] = np.trace(m)
    return out


def euler_rotation(rpy_deg) -> np.ndarray:
    r, p, y = np.radians(rpy_deg)
    return rotation(np.array([0, 0, y])) @ rotation(np.array([0, p, 0])) @ rotation(np.array([r, 0, 0]))


@dataclass(frozen=True)
class Rotation:
    """A rotation matrix in the forms that documents want."""

    m: np.ndarray

    def quaternion(self) -> list[float]:
        """x, y, z, w with w >= 0."""
        half = rotvec(self.m) / 2
        angle = float(np.linalg.norm(half))
        return [*(half * (np.sin(angle) / angle if angle > 1e-12 else 1.0)), float(np.cos(angle))]

    def rpy_deg(self) -> list[float]:
        """Turns about the fixed axes x, y, z, in this order."""
        m = self.m
        return np.degrees([np.arctan2(m[2, 1], m[2, 2]), np.arcsin(np.clip(-m[2, 0], -1, 1)), np.arctan2(m[1, 0], m[0, 0])]).tolist()

    def inverse_of(self, t) -> list[float]:
        """Translation of the inverse of (this, t)."""
        return (-self.m.T @ np.asarray(t)).tolist()


def nearest_rotation(m: np.ndarray) -> np.ndarray:
    """The rotation with the largest inner product with a matrix."""
    return rotation(rotvec(m))


def mean_rotation(matrices: np.ndarray) -> np.ndarray:
    """Chordal mean: the rotation nearest to the sum."""
    return nearest_rotation(matrices.sum(axis=0))


def spherical(p: np.ndarray) -> np.ndarray:
    """(n, 3): range, azimuth, elevation."""
    r = np.linalg.norm(p, axis=1)
    out = np.stack([r, np.arctan2(p[:, 1], p[:, 0]), np.arcsin(np.clip(p[:, 2] / np.where(r < 1e-9, 1, r), -1, 1))], axis=1)
    out[r < 1e-9] = 0
    return out


def wrapped(a: np.ndarray) -> np.ndarray:
    return (a + np.pi) % (2 * np.pi) - np.pi


# ---- closed form ----------------------------------------------------------------------------


def from_cross_covariance(h: np.ndarray, mean_p: np.ndarray, mean_q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation of p to q from the 3x3 sum of centred p q'.

    The best rotation is the one nearest to the sum's transpose; its quaternion is
    an eigenvector, so it is never a reflection.
    """
    turn = nearest_rotation(h.T)
    return turn, mean_q - turn @ mean_p


def closed_form(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mp, mq = p.mean(axis=0), q.mean(axis=0)
    return from_cross_covariance((p - mp).T @ (q - mq), mp, mq)


def cross_covariance(pairs: DataFrame) -> DataFrame:
    """(session, n, means, h00..h22) of point pairs (px..pz, qx..qz): centred in a second pass over joined means."""
    p, q = ("px", "py", "pz"), ("qx", "qy", "qz")
    means = pairs.groupBy("session").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in (*p, *q)])
    sums = [F.sum((F.col(a) - F.col(f"m_{a}")) * (F.col(b) - F.col(f"m_{b}"))).alias(f"h{i}{j}") for i, a in enumerate(p) for j, b in enumerate(q)]
    return pairs.join(means, "session").groupBy("session", "n", *[f"m_{c}" for c in (*p, *q)]).agg(*sums)


def kabsch(pairs: DataFrame) -> DataFrame:
    """(session, n, r, t): closed form for every session; only its sums reach numpy."""

    def solve(batches):
        for b in batches:
            rs, ts = [], []
            for row in b.itertuples(index=False):
                h = np.array([[getattr(row, f"h{i}{j}") for j in range(3)] for i in range(3)])
                r, t = from_cross_covariance(h, np.array([row.m_px, row.m_py, row.m_pz]), np.array([row.m_qx, row.m_qy, row.m_qz]))
                rs.append(r.ravel())
                ts.append(t)
            yield pd.DataFrame({"session": b.session, "n": b.n, "r": rs, "t": ts})

    sums = cross_covariance(pairs)
    kind = sums.schema["session"].dataType.simpleString()
    return sums.mapInPandas(solve, f"session {kind}, n long, r array<double>, t array<double>")


# ---- maximum likelihood ---------------------------------------------------------------------

#: Captures of the groups that are solved together: a task holds about 3 kB for each.
TOGETHER = 20_000
#: Sessions whose captures a task has as arrays at once.
AT_ONCE = 500

SOLVED = (
    "session {kind}, status string, n_captures int, n_inliers int, n_rejected int, elevation_used boolean, converged boolean, rank int, "
    "r array<double>, t array<double>, offset array<double>, sigma array<double>, offset_sigma array<double>, rms_sigma double, inliers array<int>"
)


def kept(errors: np.ndarray, limit: float) -> np.ndarray:
    """Which captures of one group stay, by their errors."""
    return batched.kept(errors[None], np.ones((1, len(errors)), bool), limit)[0]


def gathered(captures: DataFrame, *more: str) -> DataFrame:
    """(session, captures, ...): a row for each session, its captures in order as an array."""
    row = F.struct("capture_no", *[F.col(c).cast("array<double>").alias(c) for c in ("p", "rb", "tb")])
    return captures.groupBy("session", *more).agg(F.sort_array(F.collect_list(row)).alias("captures"))


def _chunks(sizes: list[int], copies=lambda n: n) -> Iterator[list[int]]:
    """Groups, by size, whose padded captures are about ``TOGETHER``."""
    some: list[int] = []
    for k in sorted(range(len(sizes)), key=sizes.__getitem__):
        if some and (len(some) + 1) * copies(sizes[k]) > TOGETHER:
            yield some
            some = []
        some.append(k)
    if some:
        yield some


@dataclass(frozen=True)
class Captures:
    """Captures of many groups, one after another: numbers (M,), p (M, 3), rb (M, 3, 3), tb (M, 3), and the groups' sizes (G,)."""

    numbers: np.ndarray
    p: np.ndarray
    rb: np.ndarray
    tb: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of_lists(cls, groups: list[list[dict]]) -> Captures:
        flat = [c for g in groups for c in g]
        p, rb, tb = (np.array([c[n] for c in flat], float).reshape(-1, *shape) for n, shape in (("p", (3,)), ("rb", (3, 3)), ("tb", (3,))))
        return cls(np.array([c["capture_no"] for c in flat], int), p, rb, tb, np.array([len(g) for g in groups], int))

    @classmethod
    def of_arrow(cls, groups: pa.ListArray) -> Captures:
        """Of a column of ``gathered``. A capture without its nine or three numbers is refused."""
        sizes, flat = pc.list_value_length(groups).to_numpy(zero_copy_only=False), groups.flatten()
        numbers, *lists = (flat.field(n) for n in ("capture_no", "p", "rb", "tb"))
        parts = []
        for column, shape in zip(lists, ((3,), (3, 3), (3,)), strict=True):
            values = column.flatten()
            if values.null_count or not (pc.list_value_length(column).to_numpy(zero_copy_only=False) == np.prod(shape)).all():
                raise ValueError("a capture lacks numbers of its point or pose")
            parts.append(values.to_numpy(zero_copy_only=False).reshape(-1, *shape))
        return cls(numbers.to_numpy(zero_copy_only=False), *parts, sizes)

    def padded(self, some: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Some groups' p (G, N, 3), rb (G, N, 3, 3), tb (G, N, 3), there (G, N) and numbers (G, N); what is padded looks ahead."""
        sizes = self.sizes[some]
        there = np.arange(sizes.max()) < sizes[:, None]
        at = np.where(there, (np.cumsum(self.sizes) - self.sizes)[some][:, None] + np.arange(sizes.max()), 0)
        filled = lambda values, ahead: np.where(there.reshape(*there.shape, *[1] * np.ndim(ahead)), values[at], ahead)
        return filled(self.p, np.ones(3)), filled(self.rb, np.eye(3)), filled(self.tb, np.ones(3)), there, self.numbers[at]


def solutions_of(groups: list[list[dict]] | Captures, params: Params) -> list[dict]:
    """The columns of ``SOLVED`` but the session for each group of captures."""
    all_ = groups if isinstance(groups, Captures) else Captures.of_lists(groups)
    sizes = all_.sizes.tolist()
    out: list[dict] = [{"status": "insufficient", "n_captures": n} for n in sizes]
    able = [k for k, n in enumerate(sizes) if n >= 4]
    for chunk in _chunks([sizes[k] for k in able]):
        some = [able[k] for k in chunk]
        p, rb, tb, there, numbers = all_.padded(some)
        elevation = batched.has_elevation(p, there, params)
        s = batched.maximum_likelihood(p, rb, tb, there, params, elevation)
        sigma = np.sqrt(np.clip(np.einsum("gii->gi", s.cov), 0, None))
        found = {"elevation_used": elevation, "converged": s.converged, "rank": s.rank, "r": s.r.reshape(-1, 9), "t": s.t, "offset": s.offset, "sigma": sigma, "offset_sigma": s.offset_sigma, "rms_sigma": s.rms_sigma}
        rows = zip(*[v.tolist() for v in found.values()], strict=True)
        for i, (k, row) in enumerate(zip(some, rows, strict=True)):
            inside = numbers[i][s.inliers[i]].tolist()
            out[k] |= {"status": "solved", "n_inliers": len(inside), "n_rejected": sizes[k] - len(inside), "inliers": inside} | dict(zip(found, row, strict=True))
    return out


def _arrow(schema: str):
    struct = T.StructType.fromDDL(schema)
    return struct, to_arrow_schema(struct)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of gathered batches, of ``AT_ONCE`` sessions."""
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            yield b.slice(at, AT_ONCE)


def solved(captures: DataFrame, params: Params) -> DataFrame:
    """One row for each session. Fewer than 4 captures: status ``insufficient`` and nulls.

    Sessions are rows of an array that one task solves together; a session's captures are
    tens, since the capture rule makes that many in an hour.
    """
    struct, arrow = _arrow(SOLVED.format(kind=captures.schema["session"].dataType.simpleString()))

    def run(batches):
        for b in sliced(batches):
            found = solutions_of(Captures.of_arrow(b.column("captures")), params)
            columns = [b.column("session") if n == "session" else [x.get(n) for x in found] for n in arrow.names]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return gathered(captures).mapInArrow(run, struct)


def leave_one_out(captures: DataFrame, solutions: DataFrame, params: Params) -> DataFrame:
    """(session, fold, sigma_error) of each inlier capture, left out of a refit on the rest.

    The offset is the solved one, without priors. Sessions with fewer than 5 inliers have
    no folds. All folds of many sessions are solved together.
    """
    known = solutions.where("n_inliers >= 5").select("session", "inliers", "offset", "elevation_used")
    rows = captures.join(known, "session").where(F.array_contains("inliers", F.col("capture_no")))
    struct, arrow = _arrow(f"session {captures.schema['session'].dataType.simpleString()}, fold int, sigma_error double")
    plain = Params().with_values(sigma_range_m=params.sigma_range_m, sigma_az_deg=params.sigma_az_deg, sigma_el_deg=params.sigma_el_deg)

    def folds(captures, offsets, elevations, some):
        p, rb, tb, there, numbers = captures.padded(some)
        which, out = np.nonzero(there)
        offset, elevation = offsets[some][which], elevations[some][which]
        p, rb, tb, there = p[which], rb[which], tb[which], there[which]
        alone = np.zeros_like(there)
        alone[np.arange(len(out)), out] = True
        s = batched.maximum_likelihood(p, rb, tb, there & ~alone, plain, elevation, offset, solve_offset=False, priors=False, max_iter=3, sure=False, bends=True)
        errors = batched.held_out_errors(s, p, rb, tb, alone, plain, elevation)[np.arange(len(out)), out]
        return np.array(some)[which], numbers[which, out], errors

    def run(batches):
        for b in sliced(batches):
            captures = Captures.of_arrow(b.column("captures"))
            offsets = b.column("offset").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
            elevations = b.column("elevation_used").to_numpy(zero_copy_only=False).astype(bool)
            for some in _chunks(captures.sizes.tolist(), lambda n: n * n):
                which, numbers, errors = folds(captures, offsets, elevations, some)
                columns = [b.column("session").take(pa.array(which)), numbers, errors]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return gathered(rows, "offset", "elevation_used").mapInArrow(run, struct)


def fold_exclusion(rows: DataFrame) -> DataFrame:
    """Each row (session, capture_no, value) with n_train and mean_train of its session's other
    rows, from the session's sums; rows that are alone have no fold."""
    sums = rows.groupBy("session").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    folds = rows.join(sums, "session").where("n > 1").withColumn("n_train", F.col("n") - 1)
    return folds.withColumn("mean_train", (F.col("total") - F.col("value")) / F.col("n_train")).drop("n", "total")


def chordal_means(rotations: DataFrame) -> DataFrame:
    """(session, n, r): rotation nearest to the sum of each session's rotations (column rb, 9); only sums reach numpy."""
    sums = rotations.groupBy("session").agg(F.count("*").alias("n"), *[F.sum(F.get("rb", F.lit(i))).alias(f"s{i}") for i in range(9)])
    kind = sums.schema["session"].dataType.simpleString()

    def solve(batches):
        for b in batches:
            m = b[[f"s{i}" for i in range(9)]].to_numpy().reshape(-1, 3, 3)
            yield pd.DataFrame({"session": b.session, "n": b.n, "r": [nearest_rotation(x).ravel() for x in m]})

    return sums.mapInPandas(solve, f"session {kind}, n long, r array<double>")

"""Rules of the live calibration with state: background pooling, feedback of a solution, the latch.

The capture rule is ``plumbline.operators.capture.Captures``; all are folded over
tables and streams by ``folds``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from plumbline.schemas import Params


@dataclass(frozen=True)
class Background:
    """After the command ``background`` the next ``frames`` clouds that aren't empty are pooled and put
    out together once whole. A further command begins anew; a reset doesn't touch the pool."""

    frames: int
    columns: tuple[str, ...] = ("cmd", "n_points")
    schema: str = "session long, pool_no int, stamp_us long, id long"

    def start(self) -> dict:
        return {"pooling": None, "pools": 0}

    def step(self, state: dict, session: int, stamp: int, key: int, cmd: str | None, n_points: int | None) -> list[tuple]:
        if cmd == "background":
            state["pooling"] = []
        elif cmd is None and n_points and state["pooling"] is not None:
            state["pooling"].append([stamp, key])
            if len(state["pooling"]) == self.frames:
                out, state["pooling"] = state["pooling"], None
                state["pools"] += 1
                return [(session, state["pools"], *x) for x in out]
        return []


@dataclass(frozen=True)
class Feedback:
    """Gates each frame's return by where the newest solution puts the camera's point, before the
    first by the prior. Rows with ``solution`` (rotation in row order, then translation) are solutions;
    the command ``reset`` forgets the last. Puts out the distance and whether it is within ``radius``."""

    prior: tuple[float, ...]
    radius: float
    columns: tuple[str, ...] = ("cx", "cy", "cz", "px", "py", "pz", "cmd", "solution")
    schema: str = "session long, stamp_us long, id long, solved boolean, distance double, passes boolean"

    def start(self) -> dict:
        return {"solution": None}

    def step(self, state: dict, session: int, stamp: int, key: int, cx, cy, cz, px, py, pz, cmd: str | None, solution) -> list[tuple]:
        if cmd == "reset":
            state["solution"] = None
        elif solution is not None:
            state["solution"] = [float(x) for x in solution]
        elif cmd is None:
            m = state["solution"] or self.prior
            d = cx - m[9], cy - m[10], cz - m[11]
            at = [m[k] * d[0] + m[k + 3] * d[1] + m[k + 6] * d[2] for k in range(3)]
            off = math.dist(at, (px, py, pz))
            return [(session, stamp, key, state["solution"] is not None, off, off <= self.radius)]
        return []


@dataclass(frozen=True)
class Latch:
    """Pools relative poses, averages them and locks once the mean stands still, as
    ``posepool.calibrated_pairs`` does: live rows up to the locked one, nothing after.
    A pose that isn't whole (a null, a NaN, an infinity) is passed over.
    The command ``reset`` begins anew."""

    params: Params
    columns: tuple[str, ...] = ("qx", "qy", "qz", "qw", "tx", "ty", "tz", "cmd")
    schema: str = "session long, seq long, pooled long, stage string, qx double, qy double, qz double, qw double, tx double, ty double, tz double"

    def start(self) -> dict:
        return {"pool": [], "sum": [0.0] * 7, "means": [], "run": 0, "locked": False}

    def step(self, state: dict, session: int, stamp: int, key: int, *values) -> list[tuple]:
        *pose, cmd = values
        if cmd == "reset":
            state.update(self.start())
        if cmd is not None or state["locked"] or not all(x is not None and math.isfinite(x) for x in pose):
            return []
        p = self.params
        if pose[3] < 0:
            pose[:4] = [-x for x in pose[:4]]
        state["pool"].append(pose)
        gone = state["pool"].pop(0) if len(state["pool"]) > p.pool_cap else [0.0] * 7
        state["sum"] = [s + x - y for s, x, y in zip(state["sum"], pose, gone, strict=True)]
        n = len(state["pool"])
        mean = [s / n for s in state["sum"]]
        size = math.hypot(*mean[:4])
        q, t = [x / size for x in mean[:4]], mean[4:]
        sine = math.hypot(*q[:3])
        turn = 2.0 if sine < 1e-12 else 2 * math.atan2(sine, q[3]) / sine
        state["means"] = [*state["means"], [*t, *(x * turn for x in q[:3])]][-p.conv_window :]
        still = len(state["means"]) == p.conv_window and n > p.conv_pool
        if still:
            t_std, rot_std = (_spread([m[k : k + 3] for m in state["means"]]) for k in (0, 3))
            still = t_std < p.conv_t_std and math.degrees(rot_std) < p.conv_rot_std_deg
        state["run"] = state["run"] + 1 if still else 0
        state["locked"] = state["run"] >= p.conv_hold
        return [(session, key, n, "locked" if state["locked"] else "live", *q, *t)]


def _spread(points: list) -> float:
    """Root of the summed population variances."""
    n = len(points)
    return math.sqrt(sum(sum((x - sum(c) / n) ** 2 for x in c) / n for c in zip(*points, strict=True)))

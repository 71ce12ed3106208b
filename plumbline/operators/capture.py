"""Stability windows over synchronised pairs, and greedy captures.

Pairs are rows (session, stamp_us, id, cx, cy, cz, px, py, pz): the target seen by
the camera and by the sensor. Windows are of rows: frames without a pair are
skipped, not gaps.

A capture depends on the one before, so a session is folded in order by one task;
it holds the rule's state alone, so a session of any length fits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import geometry as g
from plumbline.streaming.folds import folded

CAMERA, SENSOR = ("cx", "cy", "cz"), ("px", "py", "pz")


def rolling_stability(pairs: DataFrame, window: int) -> DataFrame:
    """Each pair with n (pairs in the window so far), std_cam and std_sensor: roots of summed population variances."""
    w = Window.partitionBy("session").orderBy("stamp_us", "id").rowsBetween(1 - window, 0)
    spread = lambda cs: F.sqrt(sum((F.var_pop(c).over(w) for c in cs[1:]), F.var_pop(cs[0]).over(w)))
    return pairs.withColumns({"n": F.count("*").over(w), "std_cam": spread(CAMERA), "std_sensor": spread(SENSOR)})


def stable(pairs: DataFrame, window: int, std_cam: float, std_sensor: float) -> DataFrame:
    """Pairs at which the window is full and both spreads are below their limits."""
    return rolling_stability(pairs, window).where((F.col("n") >= window) & (F.col("std_cam") < std_cam) & (F.col("std_sensor") < std_sensor))


def _mean(points: list) -> list:
    return [sum(x) / len(points) for x in zip(*points, strict=True)]


def _spread(points: list) -> float:
    mean = _mean(points)
    return sum(sum((p[k] - mean[k]) ** 2 for p in points) / len(points) for k in range(len(mean))) ** 0.5


def _apart(a: list, b: list) -> float:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5


@dataclass(frozen=True)
class Captures:
    """The capture rule over pairs and commands (``cmd`` null for pairs).

    ``continuous``: a pair at least ``min_baseline`` from the last capture is captured,
    as the mean of up to 3 pairs since. ``auto``: a full window with both spreads below
    their limits is, if its mean is that far. Any other mode captures on command only.
    The command ``capture`` is remembered until it is served: not in continuous mode,
    else by the next pair that isn't still, with at least half a window (and 3 pairs),
    however near. ``reset`` forgets captures and window, and starts another segment;
    a remembered command stays. A capture empties the window. Numbers beyond a pair's six
    are averaged with it.
    """

    mode: str
    window: int
    std_cam: float
    std_sensor: float
    min_baseline: float
    columns: tuple[str, ...] = (*CAMERA, *SENSOR, "cmd")
    schema: str = "session long, segment int, capture_no int, stamp_us long, id long, cx double, cy double, cz double, px double, py double, pz double, n_pairs int"

    def start(self) -> dict:
        return {"window": [], "last": None, "count": 0, "asked": False, "segment": 0}

    def step(self, state: dict, session: int, stamp: int, key: int, *values) -> list[tuple]:
        *pair, cmd = values
        if cmd == "reset":
            state.update(window=[], last=None, count=0, segment=state["segment"] + 1)
        elif cmd == "capture":
            state["asked"] = True
        if cmd is not None:
            return []
        size = 3 if self.mode == "continuous" else self.window
        seen = state["window"] = [*state["window"], list(pair)][-size:]
        if not self._taken(state, seen, pair[:3]):
            return []
        mean = _mean(seen)
        state.update(last=mean[:3], window=[], count=state["count"] + 1)
        return [(session, state["segment"], state["count"], stamp, key, *mean, len(seen))]

    def _taken(self, state: dict, seen: list, cam: list) -> bool:
        far = lambda p: state["last"] is None or _apart(p, state["last"]) >= self.min_baseline
        if self.mode == "continuous":
            return far(cam)
        still = len(seen) >= self.window and _spread([p[:3] for p in seen]) < self.std_cam and _spread([p[3:6] for p in seen]) < self.std_sensor
        if self.mode == "auto" and still:
            return far(_mean(seen)[:3])
        if state["asked"] and len(seen) >= max(3, self.window // 2):
            state["asked"] = False
            return True
        return False


def captures(pairs: DataFrame, rule: Captures, commands: DataFrame | None = None) -> DataFrame:
    """The captures of every session; ``commands``: (session, stamp_us, id, cmd)."""
    return folded(with_commands(pairs, commands), rule)


def with_commands(pairs: DataFrame, commands: DataFrame | None = None) -> DataFrame:
    """Pairs, with cmd null, and commands, with nulls for points."""
    rows = pairs.select("session", "stamp_us", "id", *CAMERA, *SENSOR, F.lit(None).cast("string").alias("cmd"))
    return rows if commands is None else rows.unionByName(commands, allowMissingColumns=True)


def movement(pairs: DataFrame, captured: DataFrame, min_baseline: float) -> DataFrame:
    """``pairs`` with ``moved``, the distance of the camera's point from the session's last capture
    before it (null before the first), and ``passes``: none yet, or far enough."""
    w = Window.partitionBy("session").orderBy("stamp_us", "id").rowsBetween(Window.unboundedPreceding, -1)
    at = captured.select("session", "id", F.struct(*CAMERA).alias("capture"))
    rows = pairs.join(at, ["session", "id"], "left").withColumn("last", F.last("capture", ignorenulls=True).over(w))
    moved = g.distance(g.vec(*CAMERA), [F.col("last")[c] for c in CAMERA])
    return rows.withColumn("moved", moved).withColumn("passes", F.col("moved").isNull() | (F.col("moved") >= min_baseline)).drop("capture", "last")

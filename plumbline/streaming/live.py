"""Rules of the live path: one-to-one matching, the watchdog, lookups by time, gates with a
background of versions, and the loop in which a solution gates what follows.

All are folded over tables by ``folds.folded`` and over streams by ``settled.settled_folded``.
"""

from __future__ import annotations

import math
from collections.abc import Generator
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.operators import batched
from plumbline.operators.capture import Captures
from plumbline.operators.estimate import solutions_of
from plumbline.schemas import Params


@dataclass(frozen=True)
class Matcher:
    """One-to-one pairs of two sides, greedily in order of their stamps.

    A message takes, of those of the other side that wait and are at most ``slop_us`` away,
    the nearest (of equally near ones the earlier, then that with the smaller id), and both
    are gone. Else it waits itself, among at most ``queue`` of its side: the oldest goes.
    """

    slop_us: int
    queue: int
    columns: tuple[str, ...] = ("side",)
    schema: str = "session long, left_id long, right_id long, dt_us long"

    def start(self) -> dict:
        return {"left": [], "right": []}

    def step(self, state: dict, session: int, stamp: int, key: int, side: str | None) -> list[tuple]:
        if side not in state:
            return []
        other = state["right" if side == "left" else "left"]
        near = [(abs(s - stamp), s, i) for s, i in other if abs(s - stamp) <= self.slop_us]
        if not near:
            state[side] = [*state[side], [stamp, key]][-self.queue :]
            return []
        _, s, i = min(near)
        other.remove([s, i])
        return [(session, key, i, s - stamp) if side == "left" else (session, i, key, stamp - s)]


@dataclass(frozen=True)
class Watchdog:
    """``raised`` once nothing has come for longer than ``longest_us`` after a message (stamp_us is
    that message's), and ``ended``, with the whole silence, when something comes again. Nothing is
    raised before the first message."""

    longest_us: int
    columns: tuple[str, ...] = ()
    schema: str = "session long, kind string, stamp_us long, silent_us long"

    def start(self) -> dict:
        return {"last": None, "raised": False}

    def wake(self, state: dict) -> int | None:
        return None if state["last"] is None or state["raised"] else state["last"] + self.longest_us

    def woken(self, state: dict, session: int, stamp: int) -> list[tuple]:
        state["raised"] = True
        return [(session, "raised", state["last"], self.longest_us)]

    def step(self, state: dict, session: int, stamp: int, key: int) -> list[tuple]:
        out = [(session, "ended", state["last"], stamp - state["last"])] if state["raised"] else []
        state.update(last=stamp, raised=False)
        return out


@dataclass(frozen=True)
class AsOf:
    """Each row (``fact`` null) with the newest fact at or before it: its id and value, nulls before the first."""

    columns: tuple[str, ...] = ("fact", "value")
    rank: str = "fact"
    schema: str = "session long, id long, stamp_us long, fact_id long, value double"

    def start(self) -> dict:
        return {"fact": [None, None]}

    def step(self, state: dict, session: int, stamp: int, key: int, fact: int | None, value: float | None) -> list[tuple]:
        if fact == 0:
            state["fact"] = [key, value]
            return []
        return [(session, key, stamp, *state["fact"])] if fact == 1 else []


def _cell(p, size: float) -> tuple[int, int, int]:
    return tuple(math.floor(x / size) for x in p)


class Grid:
    """Points in cells of the size of a distance, so that a point is compared with those around it alone."""

    def __init__(self, points: list, size: float) -> None:
        self.size, self.cells = size, {}
        for p in points:
            self.cells.setdefault(_cell(p, size), []).append(p)

    def near(self, p) -> bool:
        """Whether any point is within the distance."""
        x, y, z = _cell(p, self.size)
        around = ((x + i, y + j, z + k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))
        return any(math.dist(p, q) <= self.size for c in around for q in self.cells.get(c, ()))


@dataclass(frozen=True)
class Gates:
    """The gates on a cloud and the choice of one return, as ``gating.selected_returns`` has them."""

    params: Params

    def chosen(self, points: list, background: Grid | None, expected, cam_range: float | None) -> list | None:
        """[x, y, z, snr, doppler] of the return, or None; ``points`` in the order that breaks ties."""
        p = self.params
        fine = [q for q in points if p.min_range <= math.hypot(*q[:3]) <= p.max_range]
        if p.max_abs_doppler > 0:
            fine = [q for q in fine if abs(q[4]) <= p.max_abs_doppler]
        if p.min_abs_doppler > 0:
            fine = [q for q in fine if abs(q[4]) >= p.min_abs_doppler]
        if background is not None:
            fine = [q for q in fine if not background.near(q[:3])]
        if cam_range is not None and p.range_gate_margin_m > 0:
            fine = [q for q in fine if abs(math.hypot(*q[:3]) - cam_range) <= p.range_gate_margin_m]
        if expected is not None:
            fine = [q for q in fine if math.dist(q[:3], expected) <= p.gate_radius] or fine
        if not fine:
            return None
        if p.select_by == "snr" and max(q[3] for q in fine) > 0:
            best = max(fine, key=lambda q: q[3])
        else:
            best = min(fine, key=lambda q: math.dist(q[:3], expected or (0, 0, 0)))
        return None if p.min_snr > 0 and best[3] < p.min_snr else best


CLOUD = ("xs", "ys", "zs", "snrs", "dopplers")


def _points(columns) -> list:
    """Points of a cloud's columns; those with a null or NaN coordinate are dropped."""
    return [list(q) for q in zip(*columns, strict=True) if all(x is not None and not math.isnan(x) for x in q)] if columns[0] is not None else []


@dataclass(frozen=True)
class GatedSelect:
    """Each frame's return behind all gates, with the background version that was whole when it came.

    The command ``background`` begins another version: the points of the next ``frames`` clouds
    that aren't empty. Until it is whole the version before it serves, the first time none (then
    nothing is rejected, or every frame if ``require_background``). A cloud is pooled before it is gated.
    """

    params: Params
    frames: int
    columns: tuple[str, ...] = ("cmd", *CLOUD, "cam_range", "px", "py", "pz")
    schema: str = "session long, stamp_us long, id long, version int, x double, y double, z double, snr double, doppler double"
    grids: dict = field(default_factory=dict, compare=False)

    def start(self) -> dict:
        return {"version": 0, "background": [], "pooling": None, "whole": 0}

    def step(self, state: dict, session: int, stamp: int, key: int, cmd: str | None, *values) -> list[tuple]:
        if cmd == "background":
            state.update(pooling=[], whole=0)
        if cmd is not None:
            return []
        *cloud, cam_range, px, py, pz = values
        points = _points(cloud)
        if points and state["pooling"] is not None:
            state["pooling"] += [q[:3] for q in points]
            state["whole"] += 1
            if state["whole"] == self.frames:
                state.update(version=state["version"] + 1, background=state["pooling"], pooling=None)
        if self.params.require_background and not state["version"]:
            return []
        expected = (px, py, pz) if px is not None else None
        best = Gates(self.params).chosen(points, self._grid(session, state), expected, cam_range)
        return [] if best is None else [(session, stamp, key, state["version"], *best)]

    def _grid(self, session: int, state: dict) -> Grid | None:
        """The version's index, built once as long as the task stays at the session."""
        if not state["version"]:
            return None
        if (session, state["version"]) not in self.grids:
            self.grids.clear()
            self.grids[session, state["version"]] = Grid(state["background"], self.params.bg_match_dist)
        return self.grids[session, state["version"]]


@dataclass(frozen=True)
class Versions:
    """Each frame's background version, as ``GatedSelect`` has it, from ``filled`` (whether its cloud has points) alone.

    ``cloud`` is the number of the cloud in a table, ``place`` its place (from 1) among those that are pooled, null if
    it isn't. So a stream's state needn't hold clouds.
    """

    frames: int
    columns: tuple[str, ...] = ("cmd", "filled", "cloud")
    schema: str = "session long, stamp_us long, id long, cloud long, version int, place int"

    def start(self) -> dict:
        return {"version": 0, "pooled": None}

    def step(self, state: dict, session: int, stamp: int, key: int, cmd: str | None, filled: bool | None, cloud: int | None) -> list[tuple]:
        if cmd == "background":
            state["pooled"] = 0
        if cmd is not None:
            return []
        place = None
        if filled and state["pooled"] is not None:
            place = state["pooled"] = state["pooled"] + 1
            if place == self.frames:
                state.update(version=state["version"] + 1, pooled=None)
        return [(session, stamp, key, cloud, state["version"], place)]


def numbered(clouds: DataFrame, params: Params) -> DataFrame:
    """Clouds with a number (``cloud``), whether they have points (``filled``), and of these the ones that any gate may
    have to do with: in range, or so near to it that they may reject one that is. To be written before use, as the numbers
    are new each time."""
    there = lambda q: reduce(and_, (q[n].isNotNull() & ~F.isnan(q[n]) for n in CLOUD))
    reach = params.bg_match_dist + 1e-6
    far = lambda q: F.sqrt(sum((q[n] * q[n] for n in CLOUD[1:3]), q[CLOUD[0]] * q[CLOUD[0]]))
    some = clouds.withColumn("there", F.filter(F.arrays_zip(*CLOUD), there))
    some = some.withColumns({"cloud": F.monotonically_increasing_id(), "filled": F.coalesce(F.size("there") > 0, F.lit(False))})
    some = some.withColumn("there", F.filter("there", lambda q: far(q).between(params.min_range - reach, params.max_range + reach)))
    return some.withColumns({n: F.col(f"there.{n}") for n in CLOUD}).drop("there")


def returns_of(frames: DataFrame, clouds: DataFrame, rule: GatedSelect) -> DataFrame:
    """The rule's rows from those of ``Versions`` and the table of ``numbered`` clouds.

    Both are dealt once, by session, and met in order of their stamps: a task holds one cloud and one background.
    Clouds that the stream gave no frame for, as they came too late, give nothing.
    """
    struct = T.StructType.fromDDL(rule.schema)
    arrow, gates, key = to_arrow_schema(struct), Gates(rule.params), ("session", "stamp_us", "id", "cloud")
    names = (*key, "version", "place", *CLOUD, "cam_range", "px", "py", "pz")
    both = frames.select(*key, "version", "place").unionByName(clouds.select(*key, *CLOUD, "cam_range", "px", "py", "pz"), allowMissingColumns=True)
    ordered = both.select(*names).repartition("session").sortWithinPartitions(*key, F.isnull("version"))  # a frame before its cloud

    def run(batches):
        at = frame = background = None
        pooled: list = []
        for batch in batches:
            out = []
            for session, stamp, id_, cloud, version, place, *values in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if at != session:
                    at, frame, background, pooled = session, None, None, []
                if version is not None:
                    frame = cloud, version, place
                    continue
                if frame is None or frame[0] != cloud:
                    continue
                _, version, place = frame
                *columns, cam_range, px, py, pz = values
                points = _points(columns)
                if place is not None:
                    pooled = [*(pooled if place > 1 else []), *(q[:3] for q in points)]
                    if place == rule.frames:
                        background, pooled = Grid(pooled, rule.params.bg_match_dist), []
                if rule.params.require_background and not version:
                    continue
                best = gates.chosen(points, background, (px, py, pz) if px is not None else None, cam_range)
                if best is not None:
                    out.append((session, stamp, id_, version, *best))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return ordered.mapInArrow(run, struct)


@dataclass(frozen=True)
class LiveLoop:
    """Frames to captures to solutions, each of which gates the frames after it.

    A frame has the target's pose in the camera (``rb``, 9 in row order, and ``tb``, or nulls where
    the target isn't seen) and a cloud. The working offset puts the target's point in the camera; the
    newest solution, before the first one ``prior`` (a rotation in row order and a translation), puts
    it where the sensor is to see it; the gates choose a return; the capture rule takes pairs, as
    means with the rotations' chordal mean. A capture solves all captures so far once these are
    ``params.min_points``; so does the command ``solve`` from 3 on (fewer than 4 have no solution).
    A solution replaces the working offset. ``reset`` forgets captures, solution and offset.
    """

    params: Params
    captures: Captures
    prior: tuple[float, ...]
    columns: tuple[str, ...] = ("cmd", "rb", "tb", *CLOUD)
    schema: str = (
        "session long, stamp_us long, id long, solved_from int, x double, y double, z double, distance double, capture_no int, "
        "solved int, rejected int, r array<double>, t array<double>, offset array<double>, sigma array<double>, rms_sigma double"
    )

    def start(self) -> dict:
        return {"rule": self.captures.start(), "held": [], "offset": list(self.params.offset), "solution": None, "from": 0}

    def step(self, state: dict, session: int, stamp: int, key: int, *values) -> list[tuple]:
        steps, answer = self.steps(state, session, stamp, key, *values), None
        while True:
            try:
                (answer,) = self.answers([steps.send(answer)])
            except StopIteration as end:
                return end.value

    def answers(self, questions: list) -> list[dict]:
        """The solutions of lists of captures."""
        return solutions_of(questions, self.params)

    def steps(self, state: dict, session: int, stamp: int, key: int, cmd: str | None, rb, tb, *cloud) -> Generator[list, dict, list[tuple]]:
        """A row's output, after it has asked for the solution of the captures so far if the row calls for one."""
        if cmd == "reset":
            rule = self.captures.start() | {"segment": state["rule"]["segment"] + 1, "asked": state["rule"]["asked"]}
            state.update(self.start() | {"rule": rule})
        elif cmd == "capture":
            self.captures.step(state["rule"], session, stamp, key, cmd)
        elif cmd == "solve" and len(state["held"]) >= 3:
            solved = yield from self._solved(state)
            return [(session, stamp, key, state["from"], *[None] * 5, *solved)]
        if cmd is not None or rb is None or tb is None:
            return []
        turn, shift = np.array(rb, float).reshape(3, 3), np.array(tb, float)
        seen = turn @ np.array(state["offset"]) + shift
        move = state["solution"] or self.prior
        expected = (np.array(move[:9]).reshape(3, 3).T @ (seen - np.array(move[9:]))).tolist()
        best = Gates(self.params).chosen(_points(cloud), None, expected, float(np.linalg.norm(seen)))
        solved_from = state["from"]
        if best is None:
            return [(session, stamp, key, solved_from, *[None] * 12)]
        got = self.captures.step(state["rule"], session, stamp, key, *seen.tolist(), *best[:3], *rb, *tb, None)
        number, solved = None, (None,) * 7
        if got:
            _, _, number, _, _, *mean, _ = got[0]
            mean_turn = batched.rotations(batched.rotation_vectors(np.array(mean[6:15]).reshape(3, 3)))
            state["held"].append({"capture_no": number, "p": mean[3:6], "rb": mean_turn.ravel().tolist(), "tb": mean[15:18]})
            if number >= self.params.min_points:
                solved = yield from self._solved(state)
        return [(session, stamp, key, solved_from, *best[:3], math.dist(best[:3], expected), number, *solved)]

    def _solved(self, state: dict) -> Generator[list, dict, tuple]:
        s = yield state["held"]
        if s["status"] != "solved":
            return (None,) * 7
        state.update(solution=[*s["r"], *s["t"]], offset=s["offset"])
        state["from"] = s["n_captures"]
        return s["n_captures"], s["n_rejected"], s["r"], s["t"], s["offset"], s["sigma"], s["rms_sigma"]

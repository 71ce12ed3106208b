"""The matcher, watchdog, lookups, versioned gates and the closed loop, row by row and over streams that restart."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators.capture import Captures
from plumbline.operators.estimate import solutions_of
from plumbline.plans import live
from plumbline.schemas import Params
from plumbline.streaming.folds import fed, folded, woken
from plumbline.streaming.live import AsOf, GatedSelect, Gates, Grid, LiveLoop, Matcher, Watchdog
from plumbline.streaming.replay import HEARTBEAT, replayed, with_heartbeat
from plumbline.streaming.settled import settled_folded


def run(rule, rows, end=None):
    """rows: (stamp, id, values...)."""
    state, out = rule.start(), []
    for stamp, key, *values in rows:
        out += fed(rule, state, 7, stamp, key, values)
    return out + (woken(rule, state, 7, end) if end else [])


def test_matcher_takes_the_nearest_and_drops_the_oldest():
    rule = Matcher(10, 2)
    rows = [(0, 1, "left"), (4, 2, "left"), (6, 3, "right"), (7, 4, "right"), (30, 5, "right"), (31, 6, "right"), (32, 7, "right"), (33, 8, None), (40, 9, "left"), (41, 10, "left"), (42, 11, "left")]
    assert [r[1:] for r in run(rule, rows)] == [(2, 3, 2), (1, 4, 7), (9, 7, -8), (10, 6, -10)]  # 5 fell out of the queue of two
    ties = [(10, 1, "left"), (14, 2, "left"), (12, 3, "right"), (12, 4, "right")]
    assert [r[1:3] for r in run(rule, ties)] == [(1, 3), (2, 4)]  # of equally near ones the earlier


def test_watchdog_raises_once_and_not_before_the_first_message():
    rule = Watchdog(100)
    assert run(rule, [], end=10_000) == []
    got = run(rule, [(0, 1), (100, 2), (201, 3), (250, 4)], end=10_000)
    assert [r[1:] for r in got] == [("raised", 100, 100), ("ended", 100, 101), ("raised", 250, 100)]
    assert run(rule, [(0, 1)], end=100) == [] and len(run(rule, [(0, 1)], end=101)) == 1


def test_lookup_takes_facts_at_the_same_stamp():
    got = run(AsOf(), [(1, 1, 1, None), (2, 2, 0, 5.0), (2, 3, 1, None), (4, 4, None, None)])
    assert got == [(7, 1, 1, None, None), (7, 3, 2, 2, 5.0)]


def test_grid_by_brute_force():
    rng = np.random.default_rng(1)
    points, asked = rng.uniform(-2, 2, (300, 3)).tolist(), rng.uniform(-2, 2, (500, 3)).tolist()
    grid = Grid(points, 0.2)
    assert [grid.near(a) for a in asked] == [min(math.dist(a, p) for p in points) <= 0.2 for a in asked]
    assert not Grid([], 0.2).near([0, 0, 0])


def cloud(*points):
    return [list(c) for c in zip(*points)] if points else [[], [], [], [], []]


def test_the_old_background_serves_until_the_next_is_whole():
    rule = GatedSelect(Params().with_values(min_snr=0.0), 2)
    near, wall = (1.0, 0.0, 0.0, 150.0, 0.0), (1.5, 0.0, 0.0, 900.0, 0.0)
    frame = lambda t, *points: (t, t, None, *cloud(*points), None, None, None, None)
    rows = [
        frame(1, near, wall), (2, 2, "background", *[None] * 9), frame(3, wall), frame(4), frame(5, wall), frame(6, near, wall),
        (7, 7, "background", *[None] * 9), frame(8, near), frame(9, near, wall), (10, 10, None, None, None, None, None, None, None, None, None, None), frame(11, near, (2.0, 0.0, 0.0, 1.0, 0.0)),
    ]
    got = {r[2]: (r[3], r[4]) for r in run(rule, rows)}
    assert got == {1: (0, 1.5), 3: (0, 1.5), 6: (1, 1.0), 8: (1, 1.0), 11: (2, 2.0)}  # 9 completes the second version, which holds both of its points
    assert run(GatedSelect(Params().with_values(require_background=True), 2), rows[:3]) == []


def test_gates_fall_back_when_nothing_is_near_the_expected_point():
    p = Params().with_values(min_snr=0.0)
    a, b = [1.0, 0, 0, 10.0, 0.0], [2.0, 0, 0, 20.0, 0.0]
    assert Gates(p).chosen([a, b], None, (1.1, 0, 0), None) == a and Gates(p).chosen([a, b], None, (1.1, 5, 0), None) == b
    assert Gates(p).chosen([a, b], None, None, 1.2) == a and Gates(p).chosen([], None, None, None) is None
    assert Gates(p.with_values(select_by="near")).chosen([b, a], None, None, None) == a
    assert Gates(p).chosen([[1.0, 0, 0, 0.0, 0.0], [0.9, 0, 0, 0.0, 0.0]], None, (1.0, 0, 0), None)[0] == 1.0
    assert Gates(p.with_values(min_snr=15.0)).chosen([a], None, None, None) is None


def rig(n, clutter=False, seed=3):
    """Frames of three at each pose: (stamp, id, cmd, rb, tb, cloud)."""
    from plumbline.operators.batched import rotations

    rng = np.random.default_rng(seed)
    r, t, a = np.array(live.TRUE_R).reshape(3, 3), np.array(live.TRUE_T), np.array(live.LOOP.offset)
    rows = []
    for k in range(n):
        if k % 3 == 0:
            q = rng.uniform(0.8, 1.9) * np.array([1, *rng.uniform(-0.4, 0.4, 2)])
            rb = rotations(rng.normal(size=3) * 0.4)
        tb = r @ q + t - rb @ a
        far = q * (1 + 0.455 / np.linalg.norm(q))
        points = [(*q, 150.0, 0.0)] + ([(*far, 800.0, 0.0)] if clutter and k >= 30 else [])
        rows.append((k, k, None, rb.ravel().tolist(), tb.tolist(), *cloud(*[tuple(map(float, p)) for p in points])))
    return rows


def test_a_solution_gates_what_follows():
    loop = LiveLoop(live.LOOP, Captures("auto", 3, 0.01, 0.08, 0.1), live.PRIOR)
    got = run(loop, rig(60, clutter=True))
    first = next(r for r in got if r[9])
    assert first[9] == live.LOOP.min_points and np.allclose(first[11], live.TRUE_R, atol=1e-6) and np.allclose(first[12], live.TRUE_T, atol=1e-6)
    assert all(r[3] == 0 and r[7] > 1e-3 for r in got[: got.index(first) + 1])  # by the prior, which is a little off
    later = got[got.index(first) + 1 :]
    assert all(r[3] >= live.LOOP.min_points and r[7] < 1e-6 for r in later)  # the stronger return behind isn't chosen any more
    blind = LiveLoop(live.LOOP.with_values(min_points=1000), Captures("auto", 3, 0.01, 0.08, 0.1), live.PRIOR)
    assert any(r[7] > 0.3 for r in run(blind, rig(60, clutter=True)))  # without a solution it is


def test_reset_and_solve_on_command():
    loop = LiveLoop(live.LOOP.with_values(min_points=100), Captures("auto", 3, 0.01, 0.08, 0.1), live.PRIOR)
    rows = rig(24)
    cmd = lambda t, c: (t, 1000 + t, c, *[None] * 7)
    got = run(loop, [*rows[:6], cmd(6, "solve"), *rows[6:12], cmd(12, "solve"), *rows[12:15], cmd(15, "reset"), *rows[15:18], cmd(18, "solve"), *rows[18:]])
    solves = [r for r in got if r[2] >= 1000]
    assert [(r[2], r[9]) for r in solves] == [(1012, 4)]  # two captures aren't enough, nor is one after the reset
    assert [r[8] for r in got if r[8]] == [1, 2, 3, 4, 5, 1, 2, 3] and [r[3] for r in got if r[2] in (13, 16)] == [4, 0]
    unseen = run(loop, [(0, 0, None, None, None, *cloud()), (1, 1, None, rows[0][3], rows[0][4], *cloud())])
    assert len(unseen) == 1 and unseen[0][4] is None


def test_two_passes_over_a_table_have_the_loops_solutions(spark):
    """Captures of a first pass, solved as they grow in a second one, are what the loop solved while it went on."""
    table = live._rig(spark, "/root/testdata/sf0.001").where("cmd is null")
    looped = folded(table, LiveLoop(live.LOOP, live.STILL, live.PRIOR)).where("solved is not null").collect()
    held = {}
    for row in folded(table, LiveLoop(live.LOOP, live.STILL, live.PRIOR)).where("capture_no is not null").orderBy("session", "capture_no").collect():
        held.setdefault(row.session, []).append(row)
    poses = {(r.session, r.id): r for r in table.select("session", "id", "rb", "tb", "qx", "qy", "qz").collect()}
    assert looped
    for row in looped:
        first = [poses[r.session, r.id] for r in held[row.session] if r.capture_no <= row.solved]
        again = solutions_of([[{"capture_no": k, "p": [c.qx, c.qy, c.qz], "rb": c.rb, "tb": c.tb} for k, c in enumerate(first)]], live.LOOP)[0]
        assert row.solved == again["n_captures"] and np.allclose(row.r, again["r"], atol=1e-6) and np.allclose(row.t, again["t"], atol=1e-6)


def test_rows_out_of_order_and_later_than_the_watermark(spark):
    """Any cut into micro-batches and any order within the lateness gives the table's rows; later rows are dropped."""
    rng = random.Random(5)
    second = 1_000_000
    rows = [(k % 3, (100 + k) * second + k % 3, k, rng.choice(["left", "right"]), rng.randrange(8)) for k in range(300)]
    late = [(k % 3, (101 + k) * second, 1000 + k, "left", 150) for k in range(5)]
    table = spark.createDataFrame([(s, t, i, side, t + lag * second) for s, t, i, side, lag in rows + late], "session long, stamp_us long, id long, side string, arrives long")
    for rule, columns in ((Matcher(5 * second, 2), ("side",)), (Watchdog(2 * second), ())):
        want = sorted(map(tuple, folded(table.where("id < 1000"), rule).collect()))
        got = replayed([with_heartbeat(table)], lambda r, rule=rule: settled_folded(r, rule, "10 seconds"), "late", parts=4, by="arrives").where(F.col("session") != HEARTBEAT)
        got = sorted(map(tuple, got.collect()))
        if columns:
            assert got == want and got
        else:  # the table's end raises nothing, the stream's heartbeat does
            assert [r for r in got if r[2] < 396 * second] == [r for r in want if r[2] < 396 * second]

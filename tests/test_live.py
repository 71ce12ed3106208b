"""The live rules, row by row."""

from plumbline.operators.capture import Captures
from plumbline.schemas import Params
from plumbline.streaming.capturing import Background, Feedback, Latch


def fed(rule, rows):
    state, out = rule.start(), []
    for k, row in enumerate(rows):
        out += rule.step(state, 7, 1000 * k, k, *row)
    return out


def pair(x, cmd=None):
    return (None,) * 6 + (cmd,) if cmd else (x, 0.0, 0.0, x, 0.0, 0.0, None)


def ids(rows):
    return [r[4] for r in rows]


def test_sweep_captures_the_pair_that_moved_and_records_the_mean():
    got = fed(Captures("continuous", 4, 0.1, 0.1, 1.0), [pair(0.0), pair(0.4), pair(0.8), pair(1.2)])
    assert ids(got) == [0, 3]  # 1.2 is far enough from 0, though the mean of the last three, 0.8, isn't
    assert abs(got[1][5] - 0.8) < 1e-12 and got[1][-1] == 3


def test_a_capture_on_command():
    rows = [pair(0.0), pair(5.0), pair(0, "capture"), pair(9.0), pair(2.0)]
    assert ids(fed(Captures("manual", 6, 0.1, 0.1, 1.0), rows)) == [3]  # half a window, three pairs
    assert ids(fed(Captures("manual", 6, 0.1, 0.1, 1.0), [r for r in rows if r[-1] is None])) == []
    assert ids(fed(Captures("auto", 6, 0.1, 0.1, 1.0), rows)) == [3]
    # in continuous mode the command isn't served; still pairs are captured without it, and it waits
    assert ids(fed(Captures("continuous", 6, 0.1, 0.1, 100.0), rows)) == [0]
    still = [pair(0, "capture"), *[pair(1.0)] * 3]
    assert ids(fed(Captures("auto", 3, 0.1, 0.1, 1.0), [*still, *[pair(1.0)] * 3, pair(8.0)])) == [3, 7]


def test_reset_begins_another_segment():
    rows = [pair(0.0), pair(3.0), pair(0, "reset"), pair(3.1), pair(6.0)]
    got = fed(Captures("continuous", 4, 0.1, 0.1, 1.0), rows)
    assert [(r[1], r[2], r[4]) for r in got] == [(0, 1, 0), (0, 2, 1), (1, 1, 3), (1, 2, 4)]


def test_background_waits_for_full_clouds_and_begins_anew():
    rows = [(None, 5), ("background", None), (None, 0), (None, 5), ("reset", None), (None, 5), ("background", None), (None, 1), ("background", None), (None, 1), (None, 2), (None, 3)]
    got = fed(Background(2), rows)
    assert [(r[1], r[3]) for r in got] == [(1, 3), (1, 5), (2, 9), (2, 10)]


def test_feedback_uses_the_newest_solution_until_reset():
    turn = (1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0)
    frame = (1.0, 0.0, 0.0, 0.5, 0.0, 0.0, None, None)
    solution = (None,) * 6 + (None, [*turn, 0.5, 0, 0])
    got = fed(Feedback((*turn, 0, 0, 0), 0.1), [frame, solution, frame, (None,) * 6 + ("reset", None), frame])
    assert [(r[3], round(r[4], 9), r[5]) for r in got] == [(False, 0.5, False), (True, 0.0, True), (False, 0.5, False)]


def test_latch_locks_once_and_a_reset_begins_anew():
    p = Params().with_values(conv_pool=2, conv_window=3, conv_hold=2)
    pose = (0.0, 0.0, 0.0, -1.0, 1.0, 0.0, 0.0, None)
    got = fed(Latch(p), [pose] * 8)
    assert [r[3] for r in got] == ["live"] * 3 + ["locked"] and got[-1][4:8] == (0.0, 0.0, 0.0, 1.0)
    again = fed(Latch(p), [*[pose] * 5, (None,) * 7 + ("reset",), *[pose] * 5])
    assert [r[3] for r in again].count("locked") == 2

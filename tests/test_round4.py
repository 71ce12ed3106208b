"""What the fourth round's findings were about: larger tables, and poses that no fit of least error finds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import batched, posefit
from plumbline.plans import common as c
from plumbline.plans import live
from plumbline.schemas import Params
from plumbline.storage import written
from plumbline.streaming.folds import folded
from plumbline.streaming.live import GatedSelect, Versions, numbered, returns_of
from plumbline.streaming.pairing import pair_blocks, pairs_of
from plumbline.streaming.replay import replayed


def test_a_streams_pairs_are_kept_as_runs(spark):
    """Dense stamps, equal ones and a missing id and stamp among them: what the stream gives grows with the rows, though the pairs are as their square."""
    slop = 1000
    left, right = (spark.range(1500).selectExpr(f"IF(id = {k}, NULL, id) AS id", f"IF(id = {k + 1}, NULL, 1600000000000000 + id % 500 * {step}) AS stamp_us") for k, step in ((3, 16), (5, 17)))
    blocks = replayed([left, right], lambda a, b: pair_blocks(a, b, slop), "runs")
    sizes = blocks.select(*[F.sum(F.size(n)).alias(n) for n in ("left_ids", "right_ids")]).first()
    a, b = (rows.toDF(f"{x}_id", f"{x}_us") for rows, x in ((left, "left"), (right, "right")))
    want = a.join(b, F.abs(F.col("left_us") - F.col("right_us")) <= slop).withColumn("dt_us", F.col("right_us") - F.col("left_us"))
    got = pairs_of(blocks).select(want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    n = want.count()
    assert n > 200_000 and sum(sizes) < 30_000, (n, sizes)


def test_a_pairs_rows_may_come_in_different_parts(spark):
    """Right rows come with their stamps, left ones a part later: those that were kept are met, each once."""
    day = 86_400_000_000
    left = spark.range(90).selectExpr("id", "1600000000000000 + id * 60000000 AS stamp_us", f"stamp_us + {day} AS arrives")
    right = spark.range(90).selectExpr("id", "1600000000000000 + id * 60000000 + 5 AS stamp_us", f"stamp_us + IF(id % 2 = 0, {day}, 0) AS arrives")
    found = replayed([left.unionByName(right.limit(0)), right], lambda a, b: pair_blocks(a, b, 60_000_000, "3 days"), "parts", parts=3, by="arrives")
    got = sorted((r.left_id, r.right_id, r.dt_us) for r in pairs_of(found).collect())
    assert got == sorted((i, j, 5 + (j - i) * 60_000_000) for i in range(90) for j in (i - 1, i) if j >= 0)


SELECT_COLUMNS = "session long, stamp_us long, id long, cmd string, xs array<double>, ys array<double>, zs array<double>, snrs array<double>, dopplers array<double>, cam_range double, px double, py double, pz double"


@pytest.mark.parametrize("values", [{}, {"require_background": True}, {"min_range": 0.9, "max_range": 1.3, "range_gate_margin_m": -1.0, "select_by": "nearest"}])
def test_gates_behind_versions_are_those_of_the_rule(spark, values):
    """Frames without points, points that lack a number, points out of range that reject ones in range, pools that a command cuts short."""
    draw, rows = random.Random(3), []
    for i in range(700):
        points = [(draw.choice((0.0, draw.uniform(-0.1, 0.1), draw.uniform(0.4, 2.8))), *(draw.uniform(-0.3, 0.3) for _ in "yz"), draw.choice((5.0, 120.0, 300.0)), 0.0) for _ in range(draw.choice((0, 1, 6, 9)))]
        points = [tuple(float("nan") if draw.random() < 0.02 else None if draw.random() < 0.02 else x for x in q) for q in points]
        seen = (draw.uniform(0.5, 2.5), 1.0, 0.0, 0.0) if draw.random() < 0.8 else (None,) * 4
        lists = [list(x) for x in zip(*points)] if points else [None if draw.random() < 0.5 else []] * 5
        rows.append((i % 5, 10**15 + i // 3, i, draw.choice((None,) * 7 + ("background", "capture")), *lists, *seen))
    rule = GatedSelect(Params().with_values(min_snr=50.0, **values), 2)
    frames = spark.createDataFrame(rows, T.StructType.fromDDL(SELECT_COLUMNS)).repartition(4)
    clouds = written(numbered(frames, rule.params), "clouds")
    got = returns_of(folded(clouds, Versions(2)), clouds, rule)
    want = sorted(tuple(r) for r in folded(frames, rule).collect())
    assert sorted(tuple(r) for r in got.collect()) == want and len({r[3] for r in want}) > 5


def test_a_stream_that_selects_returns_is_fed_no_clouds(spark, monkeypatch):
    """Its state, its shuffles and its checkpoint are then as small as a frame's keys."""
    fed = []
    monkeypatch.setattr(live, "replayed", lambda tables, *rest, **more: fed.extend(tables) or replayed(tables, *rest, **more))
    assert live.stream_select(spark, "/root/testdata/sf0.001").count() > 0
    assert fed and not [f.name for t in fed for f in t.schema if isinstance(f.dataType, T.ArrayType)]


def test_boards_tilted_wrongly_have_the_least_pixel_error(spark):
    """The six frames of ``board_pose_noisy`` on sf0.1 that differ from its SQL: the minimum that the truth leads to costs more, and no start around it leads to a lower one."""
    board, k, d = np.array([(i % 8 * 0.02, i // 8 * 0.02, 0.0) for i in range(48)]), np.array(c.K).reshape(3, 3), np.array(c.D)
    frames = (163, 394, 547, 699, 725, 758)
    truth = np.array([(0, (f % 7 - 3) / 10, 0, (f % 5 - 2) / 20, (f % 3 - 1) / 20, 1 + f % 11 / 20) for f in frames])
    pixels = np.array([posefit.project(board, x[:3], x[3:], k, d) + np.random.default_rng(f).normal(size=(48, 2)) * 0.5 for f, x in zip(frames, truth, strict=True)])
    boards, there = np.tile(board, (6, 1, 1)), np.ones((6, 48), bool)
    v, _, error = posefit.fit_poses(boards, pixels, there, k, d)
    off = lambda v: np.abs(batched.rotations(v) - batched.rotations(truth[:, :3])).max(axis=(1, 2))
    near, cost = posefit._refined(truth, boards, pixels, there, k, d)
    assert (off(v) > 0.3).all() and (off(near[:, :3]) < 0.1).all() and (cost > (error * 48) ** 2 + 0.05).all()
    draw = np.random.default_rng(0)
    for _ in range(10):
        x, cost = posefit._refined(truth + draw.normal(size=(6, 6)) * ([0.3] * 3 + [0.03] * 3), boards, pixels, there, k, d)
        assert (np.where(x[:, 5] > 0, cost, np.inf) > (error * 48) ** 2 - 1e-6).all()

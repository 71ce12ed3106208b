"""The frame tree, packed clouds and the data source of recordings."""

import math
import struct

import numpy as np
import pytest

from plumbline.operators import frames
from plumbline.operators.batched import rotations
from plumbline.sources import clouds
from plumbline.sources.recording import files_of, recorded, register
from plumbline.storage import new_folder
from plumbline.streaming.replay import settings

EDGE = "child long, parent long, stamp long, tx double, ty double, tz double, qx double, qy double, qz double, qw double"


def edge(child, parent, stamp=0, t=(0.0, 0.0, 0.0), v=(0.0, 0.0, 0.0)):
    angle = float(np.linalg.norm(v))
    q = np.array(v) * (math.sin(angle / 2) / angle if angle else 0)
    return (child, parent, stamp, *map(float, t), *map(float, q), math.cos(angle / 2))


def test_a_long_chain_and_lookups_both_ways(spark):
    rng = np.random.default_rng(4)
    moves = [(rng.normal(size=3), rng.normal(size=3)) for _ in range(100)]
    edges = spark.createDataFrame([edge(k + 1, k, 0, t, v) for k, (t, v) in enumerate(moves)] + [edge(5, 77, -1)], EDGE).repartition(5)
    rooted = frames.in_roots(edges)
    assert {r.root for r in rooted.collect()} == {0} and rooted.count() == 101
    pairs = spark.createDataFrame([(100, 0), (0, 100), (30, 70), (9, 9), (9, 500), (500, 500)], "source long, target long")
    got = {(r.source, r.target): r for r in frames.looked_up(pairs, rooted).collect()}

    def pose(k):
        out = np.eye(4)
        for t, v in moves[:k]:
            m = np.eye(4)
            m[:3, :3], m[:3, 3] = rotations(v), t
            out = out @ m
        return out

    for (s, t), r in got.items():
        if max(s, t) > 100:
            assert r.tx is None and r.qw is None
            continue
        want = np.linalg.inv(pose(t)) @ pose(s)
        assert np.allclose([r.tx, r.ty, r.tz], want[:3, 3], atol=1e-9) and r.qw >= 0
        x, y, z, w = r.qx, r.qy, r.qz, r.qw
        assert np.allclose([1 - 2 * (y * y + z * z), 2 * (x * y + z * w), 2 * (x * z - y * w)], want[:3, 0], atol=1e-9)


def test_newest_edges_cycles_nulls_and_trees(spark):
    rows = [edge(1, 9, 1, (5, 0, 0)), edge(1, 0, 2, (1, 0, 0)), edge(2, 1, 1, (1, 0, 0)), edge(3, 4), edge(4, 5), edge(5, 3), edge(6, 5), edge(7, 8, 1, (2, 0, 0)), (None, 1, *edge(0, 0)[2:]), (12, None, *edge(0, 0)[2:]), (13, 1, None, *edge(0, 0)[3:])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], EDGE + ", frame string, root int")
    rooted = frames.in_roots(df)
    assert {(r.frame, r.root, r.tx) for r in rooted.collect()} == {(0, 0, 0.0), (1, 0, 1.0), (2, 0, 2.0), (7, 8, 2.0), (8, 8, 0.0)}  # 3, 4, 5 go round, and 6 hangs on them
    pairs = spark.createDataFrame([(2, 7), (6, 5), (None, 1)], "source long, target long")
    assert all(r.tx is None for r in frames.looked_up(pairs, rooted).collect())
    assert frames.in_roots(df.limit(0)).count() == 0


def message(data, fields, n, step, big=False, height=1, row_step=0, frame=1):
    described = [{"name": a, "offset": b, "datatype": c, "count": 1} for a, b, c in fields]
    return (frame, 5, height, n, big, step, row_step, described, data)


XYZ = [("x", 0, 7), ("y", 4, 7), ("z", 8, 7)]


def test_messages_of_every_kind(spark):
    plain = struct.pack("<6f", 1, 2, 3, 4, float("nan"), 6)
    rows = [
        message(plain, XYZ, 2, 12),
        message(struct.pack(">hxx3fB", 7, 1.5, 2.5, 3.5, 9), [("intensity", 0, 3), ("x", 4, 7), ("y", 8, 7), ("z", 12, 7), ("tag", 16, 2)], 1, 17, big=True, frame=2),
        message(b"".join(struct.pack("<6f", *range(k, k + 6)) + b"\xff" * 5 for k in (0, 10)), XYZ, 2, 12, height=2, row_step=29, frame=3),
        message(plain[:-1], XYZ, 2, 12, frame=4), message(None, XYZ, 2, 12, frame=5), message(plain, XYZ[:2], 2, 12, frame=6), message(b"", XYZ, 0, 12, frame=7), message(plain, [("x", 0, 7), ("y", 4, 7), ("z", 11, 8)], 2, 12, frame=8),
        message(plain, [*XYZ, ("odd", 0, 99)], 2, 12, frame=9), message(plain, XYZ, 2, 0, frame=10), (None, None, None, None, None, None, None, None, None),
    ]
    rows = [r if r[2] is not None else (11, 5, 1, 1, False, 12, 0, None, b"0" * 12) for r in rows]
    got = clouds.decoded(spark.createDataFrame(rows, clouds.MESSAGE)).collect()
    by = {}
    for r in got:
        by.setdefault(r.frame_id, []).append(tuple(r)[1:])
    assert by[1] == by[9] == [(0, 1.0, 2.0, 3.0, 0.0, 0.0)]  # the second point has a NaN
    assert by[2] == [(0, 1.5, 2.5, 3.5, 7.0, 0.0)]
    assert [p[:2] for p in by[3]] == [(0, 0.0), (1, 3.0), (2, 10.0), (3, 13.0)]
    assert set(by) == {1, 2, 3, 9} and clouds.decoded(spark.createDataFrame([], clouds.MESSAGE)).count() == 0


@pytest.mark.parametrize("layout", [({"x": "f8", "y": "f8", "z": "f8", "n": "i4"}, False, None, None), ({"n": "u1", "z": "f4", "y": "f8", "x": "f8"}, True, 40, 3)])
def test_round_trip(spark, layout):
    points = spark.range(50).selectExpr("id frame_id", "id * 7 stamp_us", "transform(sequence(1, cast(id % 13 as int)), k -> named_struct('x', id + k / 8d, 'y', -k / 4d, 'z', k * 0.5d, 'n', k)) points").where("frame_id % 13 > 0")
    back = clouds.decoded(clouds.packed(points, *layout), {"x": "x", "y": "y", "z": "z", "n": "n"}, ("frame_id", "stamp_us"))
    want = points.selectExpr("frame_id", "stamp_us", "posexplode(points) as (point_idx, p)").selectExpr("frame_id", "stamp_us", "point_idx", "p.x", "p.y", "p.z", "cast(p.n as double) n")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))


def frames_from(spark, first, n):
    return clouds.packed(spark.range(first, first + n).selectExpr("id frame_id", "id * 10 stamp_us", "transform(sequence(1, 4), k -> named_struct('x', k + 0d, 'y', 0d, 'z', 0d, 'intensity', id * 1d, 'doppler', k - 2d)) points"), {n: "f8" for n in ("x", "y", "z", "intensity", "doppler")})


def test_filters_are_taken_over_and_row_groups_left_out(spark, capfd):
    register(spark)
    path = new_folder(spark, "recording") + "/table"
    for k in range(4):
        recorded(frames_from(spark, 100 * k, 100).coalesce(1), path, "append")
    assert len(files_of(path)) == 4
    with settings(spark, {"spark.sql.python.filterPushdown.enabled": "true"}):
        read = lambda: spark.read.format("plumbline_recording").schema("frame_id long, x double, range double").load(path)
        some = read().where("frame_id >= 350 and range <= 2 and x > 1")
        assert sorted(map(tuple, some.collect())) == [(k, 2.0, 2.0) for k in range(350, 400)]
        some.explain()
        plan = capfd.readouterr().out
        assert "BatchScan" in plan and "Filter" not in plan.replace("RuntimeFilters", "")  # the scan took all over: no filter is left above it
        assert some.rdd.getNumPartitions() == 1 and read().rdd.getNumPartitions() == 4
        assert read().where("frame_id > 900").count() == 0


def test_a_stream_of_a_recording_goes_on_from_its_offset(spark):
    register(spark)
    folder = new_folder(spark, "recorded")
    seen = []
    for k in range(3):
        recorded(frames_from(spark, 100 * k, 10).coalesce(1), f"{folder}/in/{k:03d}", "append")
        rows = spark.readStream.format("plumbline_recording").load(f"{folder}/in")
        rows.select("frame_id", "x").writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
        seen.append(spark.read.parquet(f"{folder}/out").count())
    assert seen == [40, 80, 120]
    assert spark.read.parquet(f"{folder}/out").distinct().count() == 120

"""A tree of frames: poses of children in their parents, and the pose of any frame in any other.

Edges are (child, parent, stamp, tx, ty, tz, qx, qy, qz, qw); the newest edge of a child is
the one that holds. Every frame is taken to the root of its tree by pointer jumping: each
round a frame takes over the ancestor of its ancestor, with the poses composed, so a chain of
n edges takes log2(n) rounds, each a join of one row a frame. Hot ancestors are the left
side's keys alone, which adaptive execution splits; the right side has a row for each frame.

Cases: of edges with equal stamps the one with the greatest parent, then pose, holds. Edges with
nulls don't count. Frames on a cycle have no root, and neither have those below one. Frames of
different trees have no pose in each other; a frame that is only a parent is the root of its tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.storage import Scratch, written

T, Q = ("tx", "ty", "tz"), ("qx", "qy", "qz", "qw")
POSE = (*T, *Q)


def _pose(prefix: str) -> tuple[list[Column], list[Column]]:
    return [F.col(f"{prefix}{n}") for n in T], [F.col(f"{prefix}{n}") for n in Q]


def _after(a: tuple, b: tuple) -> dict[str, Column]:
    """The pose b, in the frame of which the pose a is known, in that of a: first b, then a."""
    shift = [x + y for x, y in zip(g.turned_by(a[1], b[0]), a[0], strict=True)]
    return dict(zip(POSE, (*shift, *g.quaternion_product(a[1], b[1])), strict=True))


def newest_edges(edges: DataFrame) -> DataFrame:
    """One edge (child, parent, pose) for each child."""
    whole = edges.where(" AND ".join(f"{n} IS NOT NULL" for n in ("child", "parent", "stamp", *POSE)))
    return whole.groupBy("child").agg(F.max(F.struct("stamp", "parent", *POSE)).alias("e")).select("child", "e.parent", *[F.col(f"e.{n}").alias(n) for n in POSE])


def in_roots(edges: DataFrame) -> DataFrame:
    """(frame, root, pose of the frame in the root) of every frame that has a root; roots themselves included."""
    newest = written(newest_edges(edges), "edges")
    scratch = Scratch(edges.sparkSession)
    at = newest.select(F.col("child").alias("frame"), F.col("parent").alias("up"), *POSE)
    for _ in range(newest.count().bit_length() + 1):
        known = at.select(F.col("frame").alias("of"), F.col("up").alias("further"), *[F.col(n).alias(f"a{n}") for n in POSE])
        met = at.join(known, F.col("up") == F.col("of"), "left").withColumn("done", F.col("of").isNull())
        moved = _after(_pose("a"), _pose(""))
        step = met.select("frame", "done", F.coalesce("further", "up").alias("up"), *[F.when(F.col("done"), F.col(n)).otherwise(moved[n]).alias(n) for n in POSE])
        at = scratch.written(step, "ancestors")
        if at.where("not done").isEmpty():
            break
    out = written(at.where("done").select("frame", F.col("up").alias("root"), *POSE), "rooted")
    scratch.free()
    zero = [F.lit(0.0).alias(n) for n in POSE[:-1]]
    roots = newest.select(F.col("parent").alias("frame")).distinct().join(newest.select(F.col("child").alias("frame")), "frame", "left_anti")
    return out.unionByName(roots.select("frame", F.col("frame").alias("root"), *zero, F.lit(1.0).alias("qw")))


def looked_up(pairs: DataFrame, rooted: DataFrame) -> DataFrame:
    """``pairs`` (source, target) with the pose of the source in the target, w >= 0; nulls where there is none."""
    named = lambda p: rooted.select(F.col("frame").alias(f"{p}frame"), F.col("root").alias(f"{p}root"), *[F.col(n).alias(f"{p}{n}") for n in POSE])
    met = pairs.join(named("s_"), F.col("source") == F.col("s_frame"), "left").join(named("t_"), F.col("target") == F.col("t_frame"), "left")
    (st, sq), (tt, tq) = _pose("s_"), _pose("t_")
    back = g.conjugate(tq)
    pose = dict(zip(POSE, (*g.turned_by(back, g.minus(st, tt)), *g.quaternion_product(back, sq)), strict=True))
    same = F.col("s_root") == F.col("t_root")
    rows = met.select(*pairs.columns, *[F.when(same, c).alias(n) for n, c in pose.items()])
    return rows.withColumns({n: F.when(F.col("qw") < 0, -F.col(n)).otherwise(F.col(n)) for n in Q})

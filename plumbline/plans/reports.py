"""Queries of the sinks: documents, transforms, overlays, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.plans import common as c
from plumbline.plans import pairs
from plumbline.plans.geometry import KEY
from plumbline.sources import sinks as o
from plumbline.sources import tables as s
from plumbline.storage import new_folder


def _named_poses(spark, d):
    rows = pairs._poses(spark, d)
    return rows.withColumns({"parent": F.lit("camera"), "child": F.concat(F.lit("sensor"), F.col("seq"))})


def overlay_points(spark, d):
    """Points with x ahead, as a camera sees them."""
    turn = g.constant([0, 1, 0, 0, 0, 1, 1, 0, 0])
    out = o.overlay(s.points(spark, d), turn, g.constant([0, 0, -0.5]), g.constant(c.K), g.constant([0.0] * 5), 960, 540)
    return out.select(*KEY, "u", "v", c.rounded("depth").alias("depth"))


def _transforms(poses):
    return c.rounded_all(o.transforms_table(poses).select("parent", "child", "tx", "ty", "tz", "bx", "by_", "bz"), [])


def transforms_table(spark, d):
    return _transforms(_named_poses(spark, d))


def _document(poses, parent, child):
    keep = poses.select(F.col("seq").alias("session"), *[F.lit(x).alias(n) for n, x in (("tx", 0.25), ("ty", -0.5), ("tz", 0.75), ("qx", 0.0), ("qy", 0.6), ("qz", 0.0), ("qw", 0.8))])
    return o.result_document(keep, parent, child)


def _documents_read(spark, poses):
    """Written, then read again."""
    path = new_folder(spark, "documents")
    o.written_documents(_document(poses, "camera", "sensor"), path)
    return spark.read.json(f"{path}/json").select("session", "tx", "ty", "tz", "parent_frame", "child_frame", "static_tf_cmd")


def result_document(spark, d):
    return _documents_read(spark, _named_poses(spark, d))


def pair_document(spark, d):
    return _document(_named_poses(spark, d), "camera_a", "camera_b").select("session", "text")


def pose_sink(spark, d):
    """Poses written and read again, headers as they came."""
    path = f"{new_folder(spark, 'poses')}/table"
    pairs._poses(spark, d).select("seq", *pairs.o.T).write.parquet(path)
    return c.rounded_all(spark.read.parquet(path), [])


def report_row(spark, d):
    """A line of text for each session's mean pose."""
    rows = pairs.mean_poses(spark, d)  # rounded but once, to whole millimetres
    size = F.round(F.sqrt(F.col("mtx") ** 2 + F.col("mty") ** 2 + F.col("mtz") ** 2) * 1000).cast("long")
    return rows.select("session", F.format_string("session %d: |t| %d mm", F.col("session"), size).alias("line"))


QUERIES = {f.__name__: f for f in (overlay_points, transforms_table, result_document, pair_document, pose_sink, report_row)}

_CMD = "'static_transform_publisher --x 0.250000 --y -0.500000 --z 0.750000 --qx 0.000000 --qy 0.600000 --qz 0.000000 --qw 0.800000 --frame-id {0} --child-frame-id {1}'"
_NL = " || chr(10) || "
ORACLES = {
    "overlay_points": f"""WITH {c.POINTS}, p AS (SELECT {', '.join(KEY)}, x - 0.5 AS depth, TRY_CAST(round_even(500 * (y / (x - 0.5)) + 480, 0) AS BIGINT) AS u, TRY_CAST(round_even(510 * (z / (x - 0.5)) + 270, 0) AS BIGINT) AS v FROM points WHERE x - 0.5 > 0)
        SELECT {', '.join(KEY)}, u, v, {c.r('depth')} AS depth FROM p WHERE u >= 0 AND u < 960 AND v >= 0 AND v < 540""",
    "transforms_table": f"""WITH {pairs._POSES}, b AS (SELECT seq, {', '.join(f'{x} AS m{i}' for i, x in enumerate(pairs._M))}, tx, ty, tz FROM poses)
        SELECT 'camera' AS parent, 'sensor' || seq AS child, {c.r('tx')} AS tx, {c.r('ty')} AS ty, {c.r('tz')} AS tz, {c.r('-(m0 * tx + m3 * ty + m6 * tz)')} AS bx, {c.r('-(m1 * tx + m4 * ty + m7 * tz)')} AS by_, {c.r('-(m2 * tx + m5 * ty + m8 * tz)')} AS bz FROM b""",
    "result_document": f"SELECT o_orderkey AS session, 0.25::DOUBLE AS tx, -0.5::DOUBLE AS ty, 0.75::DOUBLE AS tz, 'camera' AS parent_frame, 'sensor' AS child_frame, {_CMD.format('camera', 'sensor')} AS static_tf_cmd FROM orders",
    "pair_document": f"""SELECT o_orderkey AS session, 'child_frame: camera_b'{_NL}'parent_frame: camera_a'{_NL}'qw: 0.8'{_NL}'qx: 0.0'{_NL}'qy: 0.6'{_NL}'qz: 0.0'{_NL}'session: ' || o_orderkey{_NL}'static_tf_cmd: ' || {_CMD.format('camera_a', 'camera_b')}{_NL}'tx: 0.25'{_NL}'ty: -0.5'{_NL}'tz: 0.75' AS text
        FROM orders""",
    "pose_sink": f"WITH {pairs._POSES} SELECT seq, {c.r('tx')} AS tx, {c.r('ty')} AS ty, {c.r('tz')} AS tz FROM poses",
    "report_row": f"""WITH {pairs._POSES}, s AS (SELECT session, avg(tx) AS x, avg(ty) AS y, avg(tz) AS z FROM poses GROUP BY session)
        SELECT session, 'session ' || session || ': |t| ' || round(sqrt(x * x + y * y + z * z) * 1000)::BIGINT || ' mm' AS line FROM s""",
}

"""Sensor-shaped tables: read from storage, or derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scanned_points(raw: DataFrame, x: str = "x", y: str = "y", z: str = "z", snr: str | None = "snr", doppler: str | None = "doppler", keep: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """The wanted point fields under their standard names.

    Rows with NaN or null in a wanted field are dropped. Optional fields that the
    input lacks are columns of zeros.
    """
    wanted = {"x": x, "y": y, "z": z} | {n: c for n, c in (("snr", snr), ("doppler", doppler)) if c in raw.columns}
    missing = [n for n in ("snr", "doppler") if n not in wanted]
    good = F.lit(True)
    for c in wanted.values():
        good &= ~F.isnan(c) & F.col(c).isNotNull()
    return raw.where(good).select(*keep, *[F.col(c).cast("double").alias(n) for n, c in wanted.items()], *[F.lit(0.0).alias(n) for n in missing])


def first_intrinsics(infos: DataFrame) -> DataFrame:
    """Each camera's intrinsics by its first message (camera, stamp_ns, k, d); no distortion means five zeros."""
    first = infos.groupBy("camera").agg(F.min(F.struct("stamp_ns", "k", "d")).alias("m")).select("camera", "m.*")
    return first.withColumn("d", F.when(F.size("d") == 0, F.array_repeat(F.lit(0.0), 5)).otherwise(F.col("d")))


def latest(rows: DataFrame, by: str, stamp: str, *values: str) -> DataFrame:
    """Newest row of each key; ties by the values."""
    return rows.groupBy(by).agg(F.max(F.struct(stamp, *values)).alias("m")).select(by, "m.*")


def board_corners(spark: SparkSession, squares_x: int, squares_y: int, square: float) -> DataFrame:
    """Inner corners of a board, row by row, from the first inner corner."""
    wide = squares_x - 1
    grid = spark.range(wide * (squares_y - 1))
    return grid.select(F.col("id").cast("int").alias("corner_id"), (F.col("id") % wide * square).alias("x"), (F.floor(F.col("id") / wide) * square).alias("y"), F.lit(0.0).alias("z"))


# ---- the test tables as sensor data ---------------------------------------------------------

#: What orders points that tie.
POINT_KEY = ("k1", "k2", "k3", "k4")


def points(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """lineitem as detections: (frame_id, k1..k4, x, y, z, snr, doppler); ``dealt`` by frame while they are lineitem's few numbers still."""
    az, el, r = F.radians(F.col("l_partkey") % 121 - 60), F.radians(F.col("l_suppkey") % 41 - 20), F.col("l_quantity") / 15
    rows = table(spark, sf_dir, "lineitem")
    raw = (rows.repartition("l_orderkey") if dealt else rows).select(
        F.col("l_orderkey").alias("frame_id"),
        F.col("l_linenumber").alias("k1"), F.col("l_partkey").alias("k2"), F.col("l_suppkey").alias("k3"), F.col("l_extendedprice").alias("k4"),
        (r * F.cos(el) * F.cos(az)).alias("x"), (r * F.cos(el) * F.sin(az)).alias("y"), (r * F.sin(el)).alias("z"),
        (F.col("l_extendedprice") / 250).alias("intensity"), ((F.col("l_discount") * 100 - 5) / 10).alias("doppler"),
    )
    return scanned_points(raw, snr="intensity", keep=("frame_id", *POINT_KEY))


def camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as frames: (frame_id, cam_range, px, py, pz), where the target is expected."""
    r, az = 0.5 + F.col("o_totalprice") / 250000, F.radians(F.col("o_custkey") % 121 - 60)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"), r.alias("cam_range"), (r * F.cos(az)).alias("px"), (r * F.sin(az)).alias("py"), F.lit(0.0).alias("pz"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def stream(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """events of one type as stamped messages: (id, stamp_us, value)."""
    rows = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return rows.select(F.col("event_id").alias("id"), micros(F.col("ts")).alias("stamp_us"), "value")


def tracks(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """events as synchronised pairs by session: camera point c and sensor point p, in metres, and ``more`` columns of events."""
    e = table(spark, sf_dir, "events")
    v, k = F.col("value"), F.col("event_id")
    return e.select(
        F.col("user_id").alias("session"), micros(F.col("ts")).alias("stamp_us"), k.alias("id"),
        (v / 100).alias("cx"), ((k % 7) / 20).alias("cy"), ((k % 11) / 25).alias("cz"),
        (v / 90).alias("px"), ((k % 5) / 15).alias("py"), ((k % 13) / 30).alias("pz"), *more,
    )


#: A rig: frames that show one pose, and captures' offset, extrinsic and clutter of the rig's frames.
POSE_FRAMES, CLUTTER_M = 4, 0.5


def rig_frames(spark: SparkSession, sf_dir: str, r: list[float], t: list[float], offset: tuple[float, ...]) -> DataFrame:
    """events as frames of a rig that rests at a pose for some frames, by session: (session, stamp_us, id, m, qx, qy, qz,
    rb, tb): the target's point as the sensor sees it without noise, and its pose in the camera under the extrinsic (r, t)."""
    order = Window.partitionBy("session").orderBy("stamp_us", "id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), micros(F.col("ts")).alias("stamp_us"), F.col("event_id").alias("id"), "event_type", "value")
    rows = rows.withColumn("m", F.floor((F.row_number().over(order) - 1) / POSE_FRAMES))
    m, k = F.col("m"), F.col("session")
    far, az, el = 0.7037 + (m * 7 + k) % 17 / 10, F.radians((m * 11 + k * 3) % 91 - 45), F.radians((m * 5 + k) % 29 - 14)
    a, b = F.radians((m * 13 + k) % 61 - 30), F.radians((m * 17) % 51 - 25)
    rows = rows.withColumns({"qx": far * F.cos(el) * F.cos(az), "qy": far * F.cos(el) * F.sin(az), "qz": far * F.sin(el), "ca": F.cos(a), "sa": F.sin(a), "cb": F.cos(b), "sb": F.sin(b)})
    ca, sa, cb, sb, q = *(F.col(n) for n in ("ca", "sa", "cb", "sb")), [F.col(n) for n in ("qx", "qy", "qz")]
    rb = [ca, -sa * cb, sa * sb, sa, ca * cb, -ca * sb, F.lit(0.0), sb, cb]
    tb = [sum((r[3 * i + j] * q[j] for j in range(3)), F.lit(t[i])) - sum((rb[3 * i + j] * offset[j] for j in range(1, 3)), rb[3 * i] * offset[0]) for i in range(3)]
    return rows.withColumns({"rb": F.array(*rb), "tb": F.array(*tb)}).drop("ca", "sa", "cb", "sb")


def rig_clouds(frames: DataFrame) -> DataFrame:
    """The frames with clouds: the target's return, and in every fifth a stronger one half a metre behind; every 13th lacks the target's."""
    k, q = F.col("id"), [F.col(n) for n in ("qx", "qy", "qz")]
    more = 1 + CLUTTER_M / F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2])
    there, clutter = k % 13 != 0, k % 5 == 0
    both = lambda own, other: F.concat(*[F.when(c, F.array(v)).otherwise(F.array().cast("array<double>")) for c, v in ((there, own), (clutter, other))])
    cloud = {f"{n}s": both(x, x * more) for n, x in zip("xyz", q, strict=True)}
    return frames.withColumns(cloud | {"snrs": both((120 + k % 50).cast("double"), F.lit(500.0)), "dopplers": both(F.lit(0.0), F.lit(0.0))})


#: Every how many-th pose of a rig is read wrongly, and by how much farther.
WRONG, WRONG_M = 6, 0.7


def noisy_captures(spark: SparkSession, sf_dir: str, r: list[float], t: list[float], offset: tuple[float, ...], sigmas: tuple[float, float, float]) -> DataFrame:
    """A capture for each pose of a rig, by session: (session, capture_no, p, rb, tb). Readings of range, azimuth
    and elevation are off by up to 1.2 of their sigmas, by numbers made from the id; every sixth is far off in range."""
    first = rig_frames(spark, sf_dir, r, t, offset).groupBy("session", "m").agg(F.min(F.struct("id", "qx", "qy", "qz", "rb", "tb")).alias("f")).select("session", "m", "f.*")
    k = F.col("id")
    off = [((k * a + b) % 2001 - 1000) / 1000 * 1.2 * s for (a, b), s in zip(((7919, 13), (104729, 7), (15485863, 101)), sigmas, strict=True)]
    far = F.sqrt(F.col("qx") ** 2 + F.col("qy") ** 2 + F.col("qz") ** 2)
    rows = first.withColumns({"far": far + off[0] + F.when(F.col("m") % WRONG == WRONG - 1, WRONG_M).otherwise(0.0), "az": F.atan2("qy", "qx") + off[1], "el": F.asin(F.col("qz") / far) + off[2]})
    p = F.array(F.col("far") * F.cos("el") * F.cos("az"), F.col("far") * F.cos("el") * F.sin("az"), F.col("far") * F.sin("el"))
    return rows.select("session", (F.col("m") + 1).cast("int").alias("capture_no"), p.alias("p"), "rb", "tb")

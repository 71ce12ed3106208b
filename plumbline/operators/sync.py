"""Pairing of two stamped streams, and lookups by time.

Time is cut into buckets as long as the slop. One side goes to its own and both
neighbouring buckets, so every pair within the slop meets in one bucket by an
equality join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pairs_within(left: DataFrame, right: DataFrame, slop_us: int) -> DataFrame:
    """All pairs with stamps at most ``slop_us`` apart: (left_id, right_id, left_us, right_us, dt_us).

    Both sides have id and stamp_us; their other columns get the prefixes l_ and r_.
    """
    bucket = F.floor(F.col("stamp_us") / slop_us)
    a = left.select(F.col("id").alias("left_id"), F.col("stamp_us").alias("left_us"), bucket.alias("bucket"), *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in ("id", "stamp_us")])
    b = right.select(F.col("id").alias("right_id"), F.col("stamp_us").alias("right_us"), F.explode(F.sequence(bucket - 1, bucket + 1)).alias("bucket"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in ("id", "stamp_us")])
    near = F.abs(F.col("left_us") - F.col("right_us")) <= slop_us
    return a.join(b, "bucket").where(near).drop("bucket").withColumn("dt_us", F.col("right_us") - F.col("left_us"))


def _nearest(rows: DataFrame, facing: DataFrame, slop_us: int) -> DataFrame:
    """(id, stamp_us, other, other_us): each row's nearest of ``facing`` within ``slop_us``; the earlier
    stamp, then the smaller id, wins ties. Both sides have id and stamp_us.

    In a bucket's merged order the nearest are the last one before and the first one
    after, so no pairs are made, however many are within the slop.
    """
    bucket = F.floor(F.col("stamp_us") / slop_us)
    found = F.struct("stamp_us", "id")
    a = rows.select("id", "stamp_us", bucket.alias("bucket"), F.lit(1).alias("kind"), F.lit(None).cast(facing.select(found.alias("f")).schema["f"].dataType).alias("other"))
    b = facing.select("id", "stamp_us", F.explode(F.sequence(bucket - 1, bucket + 1)).alias("bucket"), F.lit(0).alias("kind"), found.alias("other"))
    to_here = lambda *order: F.last("other", ignorenulls=True).over(Window.partitionBy("bucket").orderBy(*order, F.desc("id")).rowsBetween(Window.unboundedPreceding, 0))
    near = a.unionByName(b).withColumns({"before": to_here("stamp_us", "kind"), "after": to_here(F.desc("stamp_us"), "kind")}).where("kind = 1")
    gaps = {n: F.coalesce(F.abs(F.col(n)["stamp_us"] - F.col("stamp_us")), F.lit(slop_us + 1)) for n in ("before", "after")}
    best = near.withColumn("best", F.when(gaps["before"] <= gaps["after"], F.col("before")).otherwise(F.col("after")))
    return best.where(F.least(*gaps.values()) <= slop_us).select("id", "stamp_us", F.col("best.id").alias("other"), F.col("best.stamp_us").alias("other_us"))


def nearest_pairs(left: DataFrame, right: DataFrame, slop_us: int) -> DataFrame:
    """Pairs that are each other's nearest in time, at most ``slop_us`` apart: (left_id, right_id, left_us, right_us,
    dt_us) and the right side's other columns with the prefix r_.

    One-to-one, and unlike a greedy matcher independent of the order of arrival.
    """
    a = _nearest(left, right, slop_us).toDF("left_id", "left_us", "right_id", "right_us")
    b = _nearest(right, left, slop_us).select(F.col("id").alias("right_id"), F.col("other").alias("left_id"))
    pairs = a.join(b, ["left_id", "right_id"]).withColumn("dt_us", F.col("right_us") - F.col("left_us"))
    more = [F.col(c).alias(f"r_{c}") for c in right.columns if c not in ("id", "stamp_us")]
    return pairs.join(right.select(F.col("id").alias("right_id"), *more), "right_id") if more else pairs


#: Buckets in a group of buckets.
GROUP = 1000


def _carried(buckets: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before): the newest value that isn't null of the rows before each, in order of the integer key.

    Carried inside groups of ``GROUP`` keys, and from group to group over the table
    of groups, a row for each: with buckets of an hour, 41 days.
    """
    group = F.floor(F.col(key) / GROUP)
    rows = buckets.select(key, value, group.alias("group"))
    inside = Window.partitionBy("group").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.where(F.col(value).isNotNull()).groupBy("group").agg(F.max(F.struct(key, value)).alias("end"))
    groups = rows.select("group").distinct().join(ends, "group", "left")
    over = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("group", F.last("end", ignorenulls=True).over(over).getField(value).alias("former"))
    here = rows.withColumn("here", F.last(value, ignorenulls=True).over(inside))
    return here.join(groups, "group").select(key, F.coalesce("here", "former").alias("before"))


def as_of(rows: DataFrame, facts: DataFrame, values: list[str], bucket_us: int) -> DataFrame:
    """``rows`` (id, stamp_us) with the newest fact at or before each stamp, nulls where there is none.

    Both are cut into time buckets. Inside a bucket the last fact is carried forward
    by a window; what a bucket begins with is the last fact of the buckets before,
    carried over the table of buckets' last facts in two steps.
    """
    bucket = F.floor(F.col("stamp_us") / bucket_us).alias("bucket")
    fact = F.struct("stamp_us", *values)
    both = rows.select("id", "stamp_us", bucket, F.lit(1).alias("kind"), F.lit(None).cast(facts.select(fact.alias("f")).schema["f"].dataType).alias("fact"))
    both = both.unionByName(facts.select(F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "stamp_us", bucket, F.lit(0).alias("kind"), fact.alias("fact")))
    inside = Window.partitionBy("bucket").orderBy("stamp_us", "kind", "fact").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("here", F.last("fact", ignorenulls=True).over(inside)).where("kind = 1")
    ends = facts.select(bucket, fact.alias("fact")).groupBy("bucket").agg(F.max("fact").alias("last"))
    wanted = placed.select("bucket").distinct().join(ends, "bucket", "full")
    carried = _carried(wanted, "bucket", "last").withColumnRenamed("before", "begin")
    out = placed.join(carried, "bucket", "left").withColumn("fact", F.coalesce("here", "begin"))
    return out.select("id", "stamp_us", *[F.col(f"fact.{v}").alias(v) for v in values])


def silences(messages: DataFrame, longest_us: int) -> DataFrame:
    """(stamp_us, silent_us): stamps after which nothing came for longer than ``longest_us``.

    The gap to the next stamp is taken inside days; a day's last stamp meets the
    first of the next day that has any, carried over the table of days in two steps.
    """
    day = F.floor(F.col("stamp_us") / 86_400_000_000)
    rows = messages.select("stamp_us", day.alias("day"))
    inside = rows.withColumn("next", F.lead("stamp_us").over(Window.partitionBy("day").orderBy("stamp_us")))
    firsts = rows.groupBy("day").agg(F.min("stamp_us").alias("first"))
    back = firsts.select((-F.col("day")).alias("day"), "first")
    firsts = _carried(back, "day", "first").select((-F.col("day")).alias("day"), F.col("before").alias("following"))
    gaps = inside.join(firsts, "day").select("stamp_us", (F.coalesce("next", "following") - F.col("stamp_us")).alias("silent_us"))
    return gaps.where(F.col("silent_us") > longest_us)

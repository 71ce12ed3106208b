"""Ranges of a sort key as buckets of a known number, so that rows can be sent to several of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of the sample that bounds are cut from, for each bucket.
SAMPLED = 50


def buckets(spark: SparkSession, size: int, least: int) -> int:
    """At most as many buckets as shuffle partitions, none made for less than ``least`` of the size."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + size // least)


def sampled_bounds(keys: DataFrame, n: int, rows: int) -> list[str]:
    """Bounds that cut the keys (one column; ``rows`` of them) into ``n`` buckets of about one size.

    They are cut from a sample of about ``SAMPLED`` keys a bucket, as Spark's range
    partitioning does; any bounds give right results.
    """
    if n < 2 or not rows:
        return []
    found = sorted((r[0] for r in keys.sample(min(1.0, SAMPLED * n / rows), 1).collect()), key=str.encode)  # about SAMPLED * n short keys
    return sorted({found[len(found) * i // n] for i in range(1, n)}, key=str.encode) if found else []


def bucket(bounds: list, below: Callable[[Column], Column]) -> Column:
    """How many of the sorted bounds are below, by a test that holds for the first ones only,
    found in two steps of about a root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    kind = "long" if isinstance(bounds[0], int) else "string"
    listed = lambda xs: F.array(*[F.lit(x).cast(kind) for x in xs])
    coarse = F.size(F.filter(listed([g[-1] for g in groups]), below))
    fine = F.coalesce(F.try_element_at(F.array(*[listed(g) for g in groups]), coarse + 1), F.array().cast(f"array<{kind}>"))
    return F.least(coarse * step, F.lit(len(bounds))) + F.size(F.filter(fine, below))

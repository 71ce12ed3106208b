"""Windows over sessions of any length: one session's rows spread over all tasks.

Rows are sorted once by (session, order) into ranges, and numbered inside their session:
the ranges' counts, a row for each session in a range, are summed up. The numbers cut a
session into spans of ``SPAN`` rows. A rolling window over ``reach`` rows is computed span
by span, each with the last ``reach`` rows before it as a halo; a running value in two
levels, over the rows of a span and over the table of spans. No task holds more than a
span and its halo, whatever the sessions' lengths.

Cases: rows that tie in the order are numbered in an order that is kept, since the numbered
rows are a written table. Null sessions are one session. Spans must be longer than the reach.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from plumbline.operators.capture import CAMERA, SENSOR
from plumbline.operators.posepool import Q, T, normalised, poolable, with_spreads
from plumbline.schemas import Params
from plumbline.storage import written

#: Rows of a span.
SPAN = 100_000


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows``, a written table, with ``at``: the row's number in its session, from 0, by the order."""
    keys = ("session", *order)
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    table = written(ranged.withColumn("part", F.shiftright("place", 33)), "numbered")
    counts = table.groupBy("session", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("session").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("session").alias("s"), F.col("part").alias("p"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    met = table.join(counts, F.col("session").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return written(met.withColumn("at", F.col("place") - F.col("first") + F.col("before")).drop("s", "p", "first", "before", "place", "part"), "numbered")


def by_spans(rows: DataFrame, reach: int, steps: Callable[[DataFrame, WindowSpec], DataFrame], span: int = SPAN) -> DataFrame:
    """Numbered rows with columns over windows of at most ``reach`` rows before a row: ``steps`` adds them
    to the rows, spans with their halos, and gets the windows' partition and order."""
    if reach >= span:
        raise ValueError("a span must be longer than the window's reach")
    own = F.floor(F.col("at") / span)
    also = F.when(F.col("at") % span >= span - reach, F.array(own, own + 1)).otherwise(F.array(own))
    placed = rows.withColumn("span", F.explode(also))
    return steps(placed, Window.partitionBy("session", "span").orderBy("at")).where(F.col("span") == own).drop("span")


def running(rows: DataFrame, value: Column, of: Callable[[Column | str], Column] = F.max, span: int = SPAN) -> DataFrame:
    """Numbered rows with ``upto``: the largest (or ``of``) value of the session's rows so far, nulls left out, in two levels."""
    placed = rows.withColumn("span", F.floor(F.col("at") / span)).withColumn("value_", value)
    inside = Window.partitionBy("session", "span").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    spans = placed.groupBy("session", "span").agg(of("value_").alias("whole"))
    before = Window.partitionBy("session").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("session").alias("s"), F.col("span").alias("k"), of("whole").over(before).alias("former"))
    here = placed.withColumn("here", of("value_").over(inside))
    met = here.join(spans, F.col("session").eqNullSafe(F.col("s")) & (F.col("span") == F.col("k")))
    both = F.greatest("here", "former") if of is F.max else F.least("here", "former") if of is F.min else F.coalesce(F.col("here") + F.col("former"), "here", "former")
    return met.withColumn("upto", both).drop("s", "k", "former", "here", "span", "value_")


def rolling_stability(pairs: DataFrame, window: int, span: int = SPAN) -> DataFrame:
    """``capture.rolling_stability`` over sessions of any length."""

    def steps(rows: DataFrame, over: WindowSpec) -> DataFrame:
        w = over.rowsBetween(1 - window, 0)
        spread = lambda cs: F.sqrt(sum((F.var_pop(c).over(w) for c in cs[1:]), F.var_pop(cs[0]).over(w)))
        return rows.withColumns({"std_cam": spread(CAMERA), "std_sensor": spread(SENSOR)})

    rows = by_spans(numbered(pairs, "stamp_us", "id"), window - 1, steps, span)
    return rows.withColumn("n", F.least(F.col("at") + 1, F.lit(window))).drop("at")


def run_lengths(rows: DataFrame, flag: str = "stable", span: int = SPAN) -> DataFrame:
    """Numbered rows with ``run``: how many up to this one have the flag without a break."""
    broken = running(rows, F.when(F.coalesce(F.col(flag), F.lit(False)), F.lit(None)).otherwise(F.col("at")), F.max, span)
    return broken.withColumn("run", F.col("at") - F.coalesce("upto", F.lit(-1))).drop("upto")


def latched(rows: DataFrame, hold: int, span: int = SPAN) -> DataFrame:
    """``posepool.latched`` of numbered rows with ``seq`` and ``stable``."""
    runs = written(run_lengths(rows, "stable", span), "runs")
    locks = runs.where(F.col("run") >= hold).groupBy("session").agg(F.min("seq").alias("locked_at")).withColumnRenamed("session", "s")
    # a lock for each session: broadcast where the optimiser finds them small, else joined by shuffle, the hot session split
    met = runs.join(locks, F.col("session").eqNullSafe(F.col("s")), "left").drop("s", "at")
    return met.withColumn("locked", F.coalesce(F.col("seq") >= F.col("locked_at"), F.lit(False)))


def running_means(rows: DataFrame, cap: int, span: int = SPAN) -> DataFrame:
    """``posepool.running_means`` of sessions of any length: numbered rows with the pool's mean and ``pooled``.

    Sums are running only inside a span and its halo, so no error adds up along a session.
    """
    sign = F.when(F.col("qw") < 0, -1.0).otherwise(1.0)
    signed = poolable(rows).select("session", "seq", *[(F.col(c) * sign).alias(c) for c in Q], *T)
    pooled = F.least(F.col("at") + 1, F.lit(cap)).cast("long")

    def steps(rows: DataFrame, over: WindowSpec) -> DataFrame:
        rows = rows.withColumns({f"s{c}": F.sum(c).over(over.rowsBetween(Window.unboundedPreceding, 0)) for c in (*Q, *T)})
        return rows.withColumns({f"b{c}": F.lag(f"s{c}", cap).over(over) for c in (*Q, *T)})  # null where the halo begins with the pool

    got = by_spans(numbered(signed, "seq"), cap, steps, span).withColumn("pooled", pooled)
    means = {f"m{c}": (F.col(f"s{c}") - F.coalesce(f"b{c}", F.lit(0.0))) / F.col("pooled") for c in (*Q, *T)}
    return normalised(got.withColumns(means).select("session", "seq", "at", "pooled", *means))


def convergence(rows: DataFrame, p: Params, span: int = SPAN) -> DataFrame:
    """``posepool.convergence`` over sessions of any length."""
    means = written(running_means(rows, p.pool_cap, span), "means")
    full = F.col("at") + 1 >= p.conv_window
    spread = by_spans(means, p.conv_window - 1, lambda rows, over: with_spreads(rows, p, over.rowsBetween(1 - p.conv_window, 0), full), span)
    return latched(spread, p.conv_hold, span)

"""Camera-to-camera pairs: a pool of relative poses, its mean, convergence and the latch.

Rows have session, seq (their order) and a relative pose: quaternion qx qy qz qw and
translation tx ty tz.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import geometry as g
from plumbline.schemas import Params

Q, T = ("qx", "qy", "qz", "qw"), ("tx", "ty", "tz")


def _signed(c: str) -> Column:
    return F.when(F.col("qw") < 0, -F.col(c)).otherwise(F.col(c))


def se3_mean_columns(over=None) -> list[Column]:
    """Mean pose: quaternions turned to w >= 0, averaged and normalised; translations averaged."""
    avg = lambda c: F.avg(c).over(over) if over is not None else F.avg(c)
    return [avg(_signed(c)).alias(f"m{c}") for c in Q] + [avg(F.col(c)).alias(f"m{c}") for c in T]


def normalised(rows: DataFrame) -> DataFrame:
    size = F.sqrt(sum((F.col(f"m{c}") ** 2 for c in Q[1:]), F.col("mqx") ** 2))
    return rows.withColumn("size", size).withColumns({f"m{c}": F.col(f"m{c}") / F.col("size") for c in Q}).drop("size")


def poolable(rows: DataFrame) -> DataFrame:
    """Rows whose pose is whole: one number that is null, NaN or infinite would stay in the running sums for ever."""
    return rows.where(reduce(lambda a, b: a & b, [F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in (*Q, *T)]))


def running_means(rows: DataFrame, cap: int) -> DataFrame:
    """Each row's mean over the last ``cap`` poolable rows of its session, and their number ``pooled``.

    Sums over the last rows are differences of the session's running sums, so a row
    costs the same whatever ``cap`` is.
    """
    order = Window.partitionBy("session").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    signed = poolable(rows).select("session", "seq", *[_signed(c).alias(c) for c in Q], *T).withColumn("at", F.row_number().over(order))
    sums = signed.withColumns({c: F.sum(c).over(upto) for c in (*Q, *T)})
    pooled = F.least("at", F.lit(cap))
    last = {f"m{c}": (F.col(c) - F.coalesce(F.lag(c, cap).over(order), F.lit(0.0))) / pooled for c in (*Q, *T)}
    return normalised(sums.withColumns(last).select("session", "seq", pooled.cast("long").alias("pooled"), *last))


def with_spreads(means: DataFrame, p: Params, over: Window, full: Column) -> DataFrame:
    """Running means with t_std (m) and rot_std (degrees) of the last means, null while those are too few, and ``stable``."""
    sine = F.sqrt(F.col("mqx") ** 2 + F.col("mqy") ** 2 + F.col("mqz") ** 2)
    turn = F.when(F.col("sine") < 1e-12, 2.0).otherwise(2 * F.atan2("sine", "mqw") / F.when(F.col("sine") < 1e-12, 1.0).otherwise(F.col("sine")))
    means = means.withColumn("sine", sine).withColumn("turn", turn).withColumns({f"v{c}": F.col(f"m{c}") * F.col("turn") for c in Q[:3]})
    spread = lambda cs: F.sqrt(sum((F.var_pop(c).over(over) for c in cs[1:]), F.var_pop(cs[0]).over(over)))
    out = means.withColumns({"t_std": F.when(full, spread([f"m{c}" for c in T])), "rot_std": F.when(full, F.degrees(spread([f"v{c}" for c in Q[:3]])))})
    stable = (F.col("t_std") < p.conv_t_std) & (F.col("rot_std") < p.conv_rot_std_deg) & (F.col("pooled") > p.conv_pool)
    return out.withColumn("stable", F.coalesce(stable, F.lit(False))).drop("sine", "turn", *[f"v{c}" for c in Q[:3]])


def _converging(rows: DataFrame, p: Params) -> DataFrame:
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(1 - p.conv_window, 0)
    return with_spreads(running_means(rows, p.pool_cap), p, w, F.count("*").over(w) >= p.conv_window)


def convergence(rows: DataFrame, p: Params) -> DataFrame:
    """Running means with their spreads; stable; the count of stable rows in a run; locked from the first full run on."""
    return latched(_converging(rows, p), p.conv_hold)


def run_lengths(rows: DataFrame, flag: str = "stable") -> DataFrame:
    """``run``: how many rows up to this one have the flag without a break."""
    order = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    island = Window.partitionBy("session", "breaks").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("breaks", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(order))
    return out.withColumn("run", F.sum(F.when(F.col(flag), 1).otherwise(0)).over(island)).drop("breaks")


def latched(rows: DataFrame, hold: int) -> DataFrame:
    """``locked_at``: the first row of the session whose run of stable rows is long enough; ``locked`` from then on."""
    session = Window.partitionBy("session")
    out = run_lengths(rows).withColumn("locked_at", F.min(F.when(F.col("run") >= hold, F.col("seq"))).over(session))
    return out.withColumn("locked", F.coalesce(F.col("seq") >= F.col("locked_at"), F.lit(False)))


def composed_pairs(a: DataFrame, b: DataFrame, most_px: float) -> DataFrame:
    """(session, seq, quaternion, translation) of A times the inverse of B, of poses (session, seq, reproj, pose)
    paired by session and seq whose reprojection errors are both at most ``most_px``."""
    names = [*Q, *T]
    both = a.where(F.col("reproj") <= most_px).select("session", "seq", *[F.col(n).alias(f"a{n}") for n in names])
    both = both.join(b.where(F.col("reproj") <= most_px).select("session", "seq", *[F.col(n).alias(f"b{n}") for n in names]), ["session", "seq"])
    of = lambda p, ns: [F.col(f"{p}{n}") for n in ns]
    turned = g.computed(both, ["*"], dict(zip(Q, g.quaternion_product(of("a", Q), g.conjugate(of("b", Q))), strict=True)))
    back = g.turned_by([F.col(n) for n in Q], of("b", T))
    return g.computed(turned, ["session", "seq", *Q], {n: F.col(f"a{n}") - x for n, x in zip(T, back, strict=True)})


def calibrated_pairs(a: DataFrame, b: DataFrame, p: Params) -> DataFrame:
    """The pair path: poses composed, pooled, averaged, until they converge and lock.

    (session, seq, pooled, stage, mean pose) of each accepted row up to the lock, its
    row included: ``live`` before it, ``locked`` at it.
    """
    rows = run_lengths(_converging(composed_pairs(a, b, p.max_reproj_px), p)).withColumn("locks", F.col("run") >= p.conv_hold)
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("over", F.coalesce(F.max("locks").over(before), F.lit(False))).where("not over")
    stage = F.when(F.col("locks"), "locked").otherwise("live")
    return out.select("session", "seq", "pooled", stage.alias("stage"), *[F.col(f"m{n}").alias(n) for n in (*Q, *T)])


def in_world(poses: DataFrame) -> DataFrame:
    """``poses`` with the pose in the world (wtx.., wqx..) in place of the world's pose of A, null where that is unknown."""
    turn = [F.col(f"w{c}") for c in Q]
    t = [x + F.col(f"w{c}") for x, c in zip(g.turned_by(turn, [F.col(c) for c in T]), T, strict=True)]
    q = g.quaternion_product(turn, [F.col(c) for c in Q])
    known = F.col("wtx").isNotNull()
    rows = poses.withColumns({f"w{n}": F.when(known, c) for n, c in zip((*T, *Q), (*t, *q), strict=True)})
    return rows.withColumns({f"w{n}": F.when(F.col("wqw") < 0, -F.col(f"w{n}")).otherwise(F.col(f"w{n}")) for n in Q})


def placement(poses: DataFrame, mode: str) -> DataFrame:
    """What a lock publishes: ``none`` the pose of B from A; ``fixed`` B in the world, where the
    world pose is known; ``moving`` nothing. (parent, child, tx, ty, tz, qx, qy, qz, qw)"""
    from_a = poses.select(F.col("camera_a").alias("parent"), F.col("camera_b").alias("child"), *T, *Q)
    if mode == "none":
        return from_a
    if mode == "moving":
        return from_a.limit(0)
    known = in_world(poses.where(F.col("wtx").isNotNull()))
    return known.select(F.lit("world").alias("parent"), F.col("camera_b").alias("child"), *[F.col(f"w{n}").alias(n) for n in (*T, *Q)])

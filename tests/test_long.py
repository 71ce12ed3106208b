"""One session of any length, ledgers that a killed batch can't spoil, and counts of gates."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import capture, long, posepool
from plumbline.schemas import Params
from plumbline.storage import new_folder
from plumbline.streaming.ledger import Ledger, kept_in_ledger, newest
from plumbline.streaming.metrics import GateCounts, observed
from plumbline.streaming.replay import run_parts


def pairs(spark, n=5000):
    """A session of all rows but a few, with ties in the stamps."""
    rows = spark.range(n).selectExpr("case when id % 100 = 99 then id % 7 end session", "floor(id / 2) * 10 stamp_us", "id")
    return rows.select("*", *[(F.sin(F.col("id") * k) * 2).alias(c) for k, c in enumerate((*capture.CAMERA, *capture.SENSOR), 1)]).repartition(6)


def same(got, want, keys):
    a, b = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and len(a) > 0
    for k, r in a.items():
        for n in r.asDict():
            x, y = r[n], b[k][n]
            assert x == y or isinstance(x, float) and y is not None and abs(x - y) < 1e-9, (k, n, x, y)


@pytest.mark.parametrize("span", [13, 500, 100_000])
def test_spans_have_the_rows_of_plain_windows(spark, span):
    rows = pairs(spark).withColumn("session", F.coalesce("session", F.lit(-1)))
    columns = ["session", "id", "n", "std_cam", "std_sensor"]
    same(long.rolling_stability(rows, 12, span).select(columns), capture.rolling_stability(rows, 12).select(columns), ("session", "id"))
    flags = rows.select("session", F.col("id").alias("seq"), (F.col("cx") < 1.2).alias("stable"))
    columns = ["session", "seq", "run", "locked_at", "locked"]
    same(long.latched(long.numbered(flags, "seq"), 4, span).select(columns), posepool.latched(flags, 4).select(columns), ("session", "seq"))


def test_running_means_and_convergence_over_spans(spark):
    turn = [(F.sin(F.col("id") * k / 50) / 30).alias(c) for k, c in enumerate(("qx", "qy", "qz"), 1)]
    rows = pairs(spark, 3000).select(F.coalesce("session", F.lit(-1)).alias("session"), F.col("id").alias("seq"), *turn, F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0).alias("qw"), *[(F.col(c) / 1000).alias(t) for c, t in zip(capture.CAMERA, posepool.T)])
    rows = rows.withColumn("tx", F.when(F.col("seq") % 500 == 3, float("nan")).when(F.col("seq") % 500 == 4, F.lit(None)).otherwise(F.col("tx")))
    p = Params().with_values(pool_cap=40, conv_window=7, conv_hold=5, conv_pool=10)
    columns = ["session", "seq", "pooled", "t_std", "rot_std", "stable", "run", "locked_at", "locked"]
    want = posepool.convergence(rows, p).select(columns)
    same(long.convergence(rows, p, 60).select(columns), want, ("session", "seq"))
    assert want.count() == 3000 - 12  # what isn't whole isn't pooled, and spoils nothing after it
    assert want.where("t_std is null and pooled > 6").count() == 0
    with pytest.raises(ValueError):
        long.running_means(rows, 40, 40)


def test_one_session_spreads_over_all_spans(spark):
    rows = long.numbered(pairs(spark, 8000).withColumn("session", F.lit(1)), "stamp_us", "id")
    at = [r.at for r in rows.orderBy("stamp_us", "id").select("at").collect()]
    assert at == list(range(8000))
    sizes = Counter()
    seen = lambda placed, over: placed.withColumn("of", F.count("*").over(over.rowsBetween(-10**6, 10**6)))
    for r in long.by_spans(rows, 9, seen, 1000).select("of").collect():
        sizes[r.of] += 1
    assert set(sizes) == {1000, 1009} and len(rows.where("at % 1000 = 0").collect()) == 8
    assert long.numbered(pairs(spark).limit(0), "id").count() == 0


def test_running_values_in_two_levels(spark):
    rows = long.numbered(spark.range(300).selectExpr("id % 2 session", "id", "case when id % 7 < 3 then id % 11 end v"), "id")
    for of, fold in ((F.max, max), (F.min, min), (F.sum, lambda a, b: a + b)):
        for session in (0, 1):
            so_far = None
            for r in long.running(rows, F.col("v"), of, 8).where(F.col("session") == session).orderBy("id").collect():
                so_far = r.v if so_far is None else so_far if r.v is None else fold(so_far, r.v)
                assert r.upto == so_far


class Killed(Exception):
    pass


def test_a_killed_batch_is_written_once(spark):
    """The second batch dies after its rows are written and before they are entered; its replay is all that counts."""
    rows = spark.range(90).selectExpr("id % 3 session", "id stamp_us", "id * 2 value")
    died = []

    def die(batch):
        if batch == 1 and not died:
            died.append(batch)
            raise Killed

    def start(out, folder):
        ledger = Ledger(spark, f"{folder}/table")
        make = lambda: kept_in_ledger(out, ledger, f"{folder}/checkpoint", die).trigger(availableNow=True).start()
        query = make()
        try:
            query.awaitTermination()
        except Exception:
            assert ledger.batches() == [0] and died
            assert spark.read.parquet(f"{folder}/table/rows/batch=1").count() > 0  # what the killed try left
            query = make()
        return query

    folder = run_parts([rows], lambda r: r, start, "ledger")
    ledger = Ledger(spark, f"{folder}/table")
    kept = ledger.read(rows.schema)
    assert died == [1] and ledger.batches() == [0, 1, 2]
    assert sorted(r.stamp_us for r in kept.collect()) == list(range(90))
    assert sorted(map(tuple, newest(kept.drop("batch"), "session", "stamp_us").collect())) == [(0, 87, 174), (1, 88, 176), (2, 89, 178)]
    ledger.write(spark.range(5).selectExpr("id session", "id stamp_us", "id value"), 2)  # a batch that is there isn't written again
    assert ledger.read(rows.schema).count() == 90
    assert Ledger(spark, new_folder(spark, "none")).read(rows.schema).count() == 0


def test_counts_add_up_over_batches_and_restarts(spark):
    rows = spark.range(100).selectExpr("id stamp_us", "id % 10 a", "case when id % 4 > 0 then id % 3 end b")
    counts = GateCounts(spark, "g", new_folder(spark, "counts"))
    spark.streams.addListener(counts)

    def start(out, folder):
        query = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
        assert counts.ended.wait(60)
        return query

    try:
        folder = run_parts([rows], lambda r: observed(r, "g", {"n_a": F.col("a") >= 5, "n_b": F.col("b") == 1}), start, "counts")
    finally:
        spark.streams.removeListener(counts)
    totals = counts.totals(["n_raw", "n_a", "n_b"]).orderBy("batch").collect()
    want = [r for r in rows.collect() if r.a >= 5 and r.b == 1]
    assert tuple(totals[-1])[1:] == (100, 50, len(want)) and len(totals) >= 3
    assert spark.read.parquet(f"{folder}/out").count() == len(want)

"""Cumulative counts of a stream's gates, by observed metrics.

``observed`` counts, inside the query itself, how many rows pass each gate after the ones
before it; nothing is read twice. A listener keeps what each micro-batch counted in a
ledger, so that a batch that is run again counts once, and restarts go on from the sums.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from plumbline.streaming.ledger import Ledger


def observed(rows: DataFrame, name: str, gates: dict[str, Column]) -> DataFrame:
    """``rows`` that pass all gates; the metrics ``name`` have n_raw and, under each gate's name, how many are left after it."""
    counts, left = [F.count(F.lit(1)).alias("n_raw")], F.lit(True)
    for gate, passes in gates.items():
        left = left & F.coalesce(passes, F.lit(False))
        counts.append(F.count_if(left).alias(gate))
    return rows.observe(name, *counts).where(left)


class GateCounts(StreamingQueryListener):
    """Keeps the metrics ``name`` of every micro-batch in a ledger."""

    def __init__(self, spark: SparkSession, name: str, folder: str) -> None:
        self.spark, self.name, self.ledger = spark, name, Ledger(spark, folder)
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            values = row.asDict()
            self.ledger.write(self.spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} long" for n in values)), event.progress.batchId)

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def totals(self, names: list[str]) -> DataFrame:
        """(batch, counts so far) of every micro-batch: a row each."""
        rows = self.ledger.read(", ".join(f"{n} long" for n in names))
        return rows.select("batch", *[F.expr(f"sum({n}) over (order by batch)").alias(n) for n in names])

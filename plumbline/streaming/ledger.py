"""Sinks of a stream that a killed micro-batch can't spoil.

``foreachBatch`` may see a batch again after a restart. What a batch writes goes to a
folder of its number, over anything that an earlier try left there; only then is the
batch entered in the ledger, by a file that is made once. Readers take the batches that
the ledger has, so they see a batch whole or not at all, and once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.storage import hadoop


class Ledger:
    """A table ``name`` of batches in a folder of the shared store."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _entry(self, batch: int):
        return hadoop(self.spark, f"{self.folder}/ledger/{batch}")

    def has(self, batch: int) -> bool:
        fs, path = self._entry(batch)
        return fs.exists(path)

    def batches(self) -> list[int]:
        """The numbers of the batches that are there whole."""
        fs, path = hadoop(self.spark, f"{self.folder}/ledger")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path)) if fs.exists(path) else []

    def write(self, rows: DataFrame, batch: int, before_entry: Callable[[int], None] | None = None) -> None:
        """Writes a batch unless the ledger has it; give it to ``foreachBatch``."""
        if self.has(batch):
            return
        rows.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch}")
        if before_entry:
            before_entry(batch)
        fs, path = self._entry(batch)
        fs.create(path, False).close()

    def read(self, schema) -> DataFrame:
        """The rows of all batches in the ledger, with ``batch``."""
        paths = [f"{self.folder}/rows/batch={b}" for b in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/rows").parquet(*paths)


def newest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Each key's last row by ``order``: the newest document over the ones before it."""
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("row")).select(key, *[F.col(f"row.{c}").alias(c) for c in (*order, *rest)])


def kept_in_ledger(stream: DataFrame, ledger: Ledger, checkpoint: str, before_entry: Callable[[int], None] | None = None):
    """A writer of the stream into the ledger; start it with a trigger of your own."""
    return stream.writeStream.foreachBatch(lambda rows, batch: ledger.write(rows, batch, before_entry)).option("checkpointLocation", checkpoint)

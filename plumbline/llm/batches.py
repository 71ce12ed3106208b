"""Arrow batches in, Arrow batches out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Bytes of a batch that are turned into Python objects at once.
SLICE = 4 << 20


def sliced(batches: Iterable[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in parts of about ``most`` bytes; none is empty."""
    for batch in batches:
        step = max(1, batch.num_rows // -(-max(1, batch.nbytes) // most))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def mapped(df: DataFrame, per_batch: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``per_batch`` over parts of every Arrow batch; it returns a list or array per column of ``schema``.

    A task holds one part at a time; where the parts are cut has no bearing on results.
    """
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(found):
        for batch in sliced(found):
            columns = per_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]

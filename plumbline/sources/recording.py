"""A data source of recordings: folders of parquet files of packed clouds, read as points.

``spark.read.format("plumbline_recording").schema(...).load(path)`` has a column for each
field that the schema names (no more is decoded), ``frame_id``, ``stamp_us``, ``point_idx``
and ``range``, the distance from the sensor. A partition is a row group. Filters that
compare a column with numbers are taken over by the source (with
``spark.sql.python.filterPushdown.enabled``): those on frames and stamps drop row groups by
their statistics, all drop points before they become rows.

As a stream its offset is the number of files in order of their names, so a query goes on
from where its checkpoint says; new files must sort after old ones, as those that an
appending query writes in folders by time do.

The folder may be in any store that pyarrow's file systems know; a cluster's executors must
reach it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.sources.clouds import MANDATORY, MESSAGE, unpacked_together

_COMPARE = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}
#: Columns that aren't fields of a point.
OWN = {"frame_id": T.LongType(), "stamp_us": T.LongType(), "point_idx": T.IntegerType(), "range": T.DoubleType()}


@dataclass
class Group(InputPartition):
    """A row group of a file."""

    path: str
    number: int


def _opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def files_of(path: str) -> list[str]:
    """The recording's parquet files in order."""
    fs, at = _opened(path)
    found = fs.get_file_info(pa.fs.FileSelector(at, recursive=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")))


class _Reader:
    """What the batch and the stream reader share."""

    def __init__(self, schema: T.StructType, path: str) -> None:
        self.schema, self.path = schema, path
        self.limits: list[tuple[str, type, float]] = []

    def groups(self, files: Sequence[str]) -> list[Group]:
        """Row groups whose statistics of frames and stamps allow a point."""
        fs, _ = _opened(self.path)
        out = []
        for f in files:
            with fs.open_input_file(f) as opened:
                meta = pq.ParquetFile(opened).metadata
                out += [Group(f, i) for i in range(meta.num_row_groups) if self._may_have(meta.row_group(i))]
        return out

    def _may_have(self, group: pq.RowGroupMetaData) -> bool:
        for i in range(group.num_columns):
            column = group.column(i)
            s = column.statistics
            if s is None or not s.has_min_max:
                continue
            for name, kind, value in self.limits:
                if name == column.path_in_schema and name in ("frame_id", "stamp_us"):
                    below, above = s.min < value, s.max > value
                    if kind is EqualTo and not (s.min <= value <= s.max) or kind is GreaterThan and not above or kind is LessThan and not below:
                        return False
                    if kind is GreaterThanOrEqual and s.max < value or kind is LessThanOrEqual and s.min > value:
                        return False
        return True

    def read(self, partition: Group | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there is no partition
            return
        fs, _ = _opened(self.path)
        arrow = to_arrow_schema(self.schema)
        fields = [f.name for f in self.schema if f.name not in OWN]
        limited = [n for n, _, _ in self.limits if n not in OWN]
        wanted = list(dict.fromkeys([*MANDATORY, *fields, *limited]))
        with fs.open_input_file(partition.path) as opened:
            for batch in pq.ParquetFile(opened).iter_batches(batch_size=4096, row_groups=[partition.number]):
                for some, found, of, index in unpacked_together(batch, wanted):
                    if len(found):
                        yield self._points(some, found, of, index, wanted, arrow)

    def _points(self, messages: pa.RecordBatch, found: np.ndarray, of: np.ndarray, index: np.ndarray, wanted: list[str], arrow: pa.Schema) -> pa.RecordBatch:
        columns = dict(zip(wanted, found.T, strict=True))
        own = {n: messages.column(n).to_numpy(zero_copy_only=False)[of] for n in ("frame_id", "stamp_us")}
        columns |= own | {"point_idx": index, "range": np.sqrt(columns["x"] ** 2 + columns["y"] ** 2 + columns["z"] ** 2)}
        good = ~np.isnan(found).any(axis=1)
        for name, kind, value in self.limits:
            good &= _COMPARE[kind](columns[name], value)
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name][good]).cast(f.type) for f in arrow], schema=arrow)


class RecordingReader(_Reader, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        names = {f.name for f in self.schema if isinstance(f.dataType, (T.NumericType,))}
        for f in filters:
            if type(f) in _COMPARE and len(f.attribute) == 1 and f.attribute[0] in names and isinstance(f.value, (int, float)):
                self.limits.append((f.attribute[0], type(f), f.value))
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in names:
                continue  # no column is ever null
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return self.groups(files_of(self.path))


class RecordingStreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(files_of(self.path))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.groups(files_of(self.path)[start["files"] : end["files"]])

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plumbline_recording"

    def schema(self) -> str:
        return "frame_id long, stamp_us long, point_idx int, x double, y double, z double, intensity double, doppler double, range double"

    def reader(self, schema: T.StructType) -> RecordingReader:
        return RecordingReader(schema, self.options["path"])

    def streamReader(self, schema: T.StructType) -> RecordingStreamReader:
        return RecordingStreamReader(schema, self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordingSource)


def recorded(messages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes packed clouds as a recording; sorted by frame, so that row groups are ranges of frames."""
    messages.selectExpr(*[n.split()[0] for n in ("frame_id", "stamp_us", "height", "width", "is_bigendian", "point_step", "row_step", "fields", "data")]).sortWithinPartitions("frame_id").write.mode(mode).parquet(path)


__all__ = ["MESSAGE", "RecordingSource", "files_of", "recorded", "register"]

"""Vectors compressed to product codes, the nearest codebook entries found by VA-file filtering.

A vector's components are made integers, floor(256 * x), and cut into ``parts`` equal
pieces. Every part position has a codebook, which begins as that part of the first
vectors by id and is refined in rounds: each entry becomes the floored mean of the
parts next to it; an entry without parts stays.

Nearest entries: a codebook's coordinates are quantised to ``BITS`` bits a dimension,
each cell keeping the smallest and largest coordinate in it. For a batch of parts a
table a dimension gives the least and the most squared distance to each cell; added
up over the dimensions they bound the distance to every entry. Only entries whose
lower bound isn't above the smallest upper bound are compared, in integers.

Spark spreads the vectors; a round brings sums and counts of each entry to the driver
(parts * entries rows, whatever the table's size), and codebooks of a few thousand
integers go back with the task. Vectors are never shuffled.

Cases: a vector that is null, or holds a null, a NaN, an infinity or a component of
2**21 or more (whose squared distances don't fit 64 bits) has no code and isn't
returned; nor has one of another length than most of those that can be cut into the
parts (the longer of two that are as common). Fewer vectors than entries make as many
entries as there are vectors. Rows that repeat an id are vectors of their own, in
order of their components; null ids come last. Null labels are one label. An empty
table, or one without usable vectors, gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.batches import mapped, sliced
from plumbline.storage import written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Bits of a coordinate's cell.
BITS = 4
#: Components from here on aren't coded.
LIMIT = float(1 << 21)
#: Parts compared at once.
BLOCK = 4096
#: A label with this share of the rows or more has its total broadcast; at most as many labels do.
HOT = 1000
_FAR = np.iinfo(np.int64).max


class VaFile:
    """The entries of one codebook, (entries, width) integers, with the cells of their coordinates."""

    def __init__(self, entries: np.ndarray, bits: int = BITS) -> None:
        self.entries, self.cells = entries, []
        for x in entries.T:
            values, which = np.unique(x, return_inverse=True)
            cell = np.arange(len(values)) * min(1 << bits, len(values)) // len(values)
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            last = np.append(first[1:], len(values)) - 1
            self.cells.append((cell[which], values[first][:, None], values[last][:, None]))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, n): least and most squared distance of each query, (n, width), to each entry, from the cells alone."""
        least = np.zeros((len(self.entries), len(queries)), np.int64)
        most = least.copy()
        for x, (cell, low, high) in zip(queries.T, self.cells, strict=True):
            gap = np.maximum(np.maximum(low - x, x - high), 0)
            reach = np.maximum(x - low, high - x)
            least += (gap * gap)[cell]
            most += (reach * reach)[cell]
        return least, most

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each query's nearest entry, the first of equally near ones."""
        least, most = self.bounds(queries)
        entry, query = np.nonzero(least <= most.min(axis=0))
        off = self.entries[entry] - queries[query]
        exact = np.full(least.shape, _FAR)
        exact[entry, query] = (off * off).sum(axis=1)
        at = exact.argmin(axis=0)
        return at, exact[at, np.arange(len(queries))]


@dataclass(frozen=True)
class Codebooks:
    """(parts, entries, width) integers; no entries where nothing could be learnt."""

    entries: np.ndarray

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assigned(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, parts) entries of integer vectors and their squared distances."""
        parts, _, width = self.entries.shape
        at, off = np.empty((len(vectors), parts), np.int64), np.empty((len(vectors), parts), np.int64)
        for p in range(parts):
            book = VaFile(self.entries[p])
            for i in range(0, len(vectors), BLOCK):
                at[i : i + BLOCK, p], off[i : i + BLOCK, p] = book.nearest(vectors[i : i + BLOCK, p * width : (p + 1) * width])
        return at, off

    def decoded(self, code: str) -> np.ndarray:
        """The vector of a code, in the components' own units."""
        return np.concatenate([self.entries[p, e] for p, e in enumerate(bytes.fromhex(code))]) / 256


def as_integers(batch: pa.RecordBatch, length: int) -> np.ndarray:
    """(n, length) floors of 256 times the components."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(256 * flat).astype(np.int64).reshape(-1, length)


def usable(vectors: DataFrame, parts: int, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """(vec_id, label, vector) of the vectors that can be coded, whatever their length."""
    label = F.col(label_col) if label_col else F.lit(None).cast("string")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < LIMIT))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & (F.size("vector") % parts == 0) & fine)


def _sums(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, n, s0..) over all vectors: how many parts are next to each entry, and their sums."""
    parts, size, width = books.entries.shape
    schema = T.StructType.fromDDL(", ".join(["part int", "entry int", "n long", *(f"s{i} long" for i in range(width))]))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]):
        n, sums = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        for batch in sliced(batches):
            vectors = as_integers(batch, books.length)
            at, _ = books.assigned(vectors)
            for p in range(parts):
                n[p] += np.bincount(at[:, p], minlength=size)
                np.add.at(sums[p], at[:, p], vectors[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(n)
        columns = [part, entry, n[part, entry], *sums[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.select("vector").mapInArrow(run, schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in schema.names[2:]])


def learnt(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks:
    """Codebooks from all vectors, after ``rounds`` rounds. At most 256 entries."""
    rows = usable(vectors, parts, id_col, vector_col)
    common = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if common is None:
        return Codebooks(np.empty((parts, 0, 0), np.int64))
    rows = rows.where(F.size("vector") == common.length)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").toArrow().combine_chunks()
    start = np.concatenate([as_integers(b, common.length) for b in first.to_batches()])
    books = Codebooks(np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2)))
    for _ in range(rounds):
        found = _sums(rows, books).collect()  # at most parts * entries rows
        refined = books.entries.copy()
        for part, entry, n, *sums in found:
            refined[part, entry] = np.array(sums) // n
        books = Codebooks(refined)
    return books


def coded(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """(vec_id, label, code, error): two hex digits for each part, and the squared distances' sum."""
    rows = usable(vectors, len(books.entries), id_col, vector_col, label_col).where(F.size("vector") == books.length)

    def per_batch(batch):
        at, off = books.assigned(as_integers(batch, books.length))
        return {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "code": [x.tobytes().hex() for x in at.astype(np.uint8)], "error": off.sum(axis=1)}

    return mapped(rows, per_batch, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes``, a written table, with label_error: the error summed over the rows of the same label.

    Labels with a thousandth of the rows or more, at most ``HOT``, are joined by
    broadcast, so that none of them gathers in a task; all else by shuffle.
    """
    totals = written(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("of")), "label-errors")
    hot = F.col("of") * HOT >= codes.count()
    named = lambda t: t.select(F.col("label").alias("same"), "label_error")
    met = codes.join(F.broadcast(named(totals.where(hot))), F.col("label").eqNullSafe(F.col("same")), "left").drop("same")
    rest = met.where("label_error is null").drop("label_error").join(named(totals.where(~hot)), F.col("label").eqNullSafe(F.col("same"))).drop("same")
    return met.where("label_error is not null").unionByName(rest)


def compressed(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable vector."""
    books = learnt(vectors, parts, entries, rounds, id_col, vector_col)
    codes = written(coded(vectors, books, id_col, vector_col, label_col), "codes")
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))

"""Winnowing fingerprints: rolling k-gram hashes, the minimum of each window.

Of every ``window`` successive k-gram hashes the smallest is chosen, the rightmost
of equal ones, and kept with its position. Two texts that share a passage of
``window + k - 1`` code points therefore share a chosen hash. Hashes and window
minima of a text are numpy arrays, built by doubling (a hash of 2m code points
from two of m), so the cost doesn't depend on k or on the window.

Neighbours by descending id: rows are ordered by descending id and a hash of their text,
and cut into ranges that begin at rows of a sample, at most as many as there are shuffle
partitions and each of about ``PART_BYTES`` or more. Each range is sorted by itself and
gets one row more, that at which the next range begins (the last one: the first row of
all), so every row's successor is in its range. Rows that share id and text, where they
fill a range or more, are spread over several parts; in all but the last of these a row
is followed by one like itself. Texts are shuffled once, nothing global is sorted in one
task, and a task holds a few MB of texts at once, besides its longest text.

Cases: null text counts as empty and has an empty fingerprint; two empty
fingerprints are alike (1.0). A text shorter than k is one gram. Null ids come
last of all. Rows that repeat an id follow each other by the hash of their text. A table of
one row is its own neighbour; an empty table gives an empty result. Extra columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm import ranges
from plumbline.llm.batches import mapped, sliced, texts

K, WINDOW = 16, 24
#: Bytes of texts that a range of neighbours has at least, where there are so many.
PART_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_LOW = np.uint64(0xFFFFFFFF)
_LEAST = -(1 << 63)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hash of each run of k code points (of the whole text where it is shorter)."""
    k = min(k, len(points))
    if not k:
        return np.empty(0, np.uint32)
    n = len(points) - k + 1
    block, size, out, done = points.astype(np.uint64) + np.uint64(1), 1, np.zeros(len(points), np.uint64), 0
    while True:
        if k & size:
            m = len(points) - done - size + 1
            out = out[:m] * np.uint64(pow(_BASE, size, 1 << 64)) + block[done : done + m]
            done += size
        if done == k:
            break
        m = len(block) - size
        block, size = block[:m] * np.uint64(pow(_BASE, size, 1 << 64)) + block[size:], size * 2
    out = out[:n]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93 & _MASK)
    return (out >> np.uint64(32)).astype(np.uint32)


def winnowed(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the smallest hash of every window, the rightmost of equal ones."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64)
    low = (hashes.astype(np.uint64) << np.uint64(32)) | (_LOW - np.arange(n, dtype=np.uint64))
    window, size = min(window, n), 1
    while size * 2 <= window:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < window:
        low = np.minimum(low[: n - window + 1], low[window - size :])
    at = (_LOW - (low & _LOW)).astype(np.int64)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def fingerprint(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) chosen from a text."""
    hashes = gram_hashes(code_points(text), k)
    at = winnowed(hashes, window)
    return at, hashes[at]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same / (len(both) - same)


def as_text(at: np.ndarray, hashes: np.ndarray) -> str:
    """Base64 of (gap to the last position: 1 byte, hash: 4 bytes), for windows up to 256."""
    packed = np.empty(len(at), np.dtype([("gap", "u1"), ("hash", "<u4")]))
    packed["gap"] = np.diff(at, prepend=0)
    packed["hash"] = hashes
    return base64.b64encode(packed.tobytes()).decode()


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, positions, hashes) of each whole text."""

    def per_batch(batch):
        found = [fingerprint(t, k, window) for t in texts(batch)]
        return {"doc_id": batch.column("doc_id"), "positions": [a for a, _ in found], "hashes": [h.astype(np.int64) for _, h in found]}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(rows, per_batch, "doc_id long, positions array<long>, hashes array<long>")


def _order_key() -> Column:
    """32 hexadecimal digits that sort as (descending id, nulls last; hash of the text)."""
    least = F.lit(_LEAST)
    falling = F.bitwise_not(F.coalesce("doc_id", least)).bitwiseXOR(least)
    return F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (falling, F.xxhash64(F.coalesce("text", F.lit(""))))])


@dataclass(frozen=True)
class Ranges:
    """Keys at which the ranges after the first begin, and how many parts the rows with just that key are spread over."""

    begins: list[str]
    spread: list[int]

    def first_parts(self) -> list[int]:
        return list(accumulate([1, *self.spread], initial=0))

    def last_part(self, of: int) -> int:
        return self.first_parts()[of + 1] - 1


def _ranges(rows: DataFrame, parts: int, count: int) -> tuple[Ranges, DataFrame]:
    """Ranges of about one size, and the sample that they were cut from."""
    per = ranges.SAMPLED
    sample = rows.sample(min(1.0, per * parts / max(count, 1)), 1)
    found = sorted(r[0] for r in sample.select(_order_key()).collect()) if parts > 1 else []  # about SAMPLED * parts short keys
    begins = sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []
    often = Counter(found)
    return Ranges(begins, [max(1, -(-often[k] * parts // len(found))) if often[k] >= per else 1 for k in begins]), sample


def with_successor(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (part, doc_id, text, extra, alike, begins) so partitioned and sorted that the next row is the
    successor. Rows with ``extra`` are there only to be one; a part's rows are ``alike`` where its last
    row is followed by one like itself; ``begins`` marks rows with the key at which their range begins."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    key = _order_key()
    stats = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"), F.max("doc_id").alias("top")).first()
    cut, sample = _ranges(rows, ranges.buckets(spark, stats.size or 0, PART_BYTES), stats.n)
    firsts, parts = cut.first_parts(), sum(cut.spread) + 1
    listed = lambda xs, kind: F.array(*[F.lit(x).cast(kind) for x in xs])
    placed = rows.withColumn("key", key)
    placed = placed.withColumn("range", ranges.bucket(cut.begins, lambda b: b <= F.col("key")))
    placed = placed.withColumn("begins", F.coalesce(F.get(listed(["", *cut.begins], "string"), "range") == F.col("key"), F.lit(False)))
    spread = F.get(listed([1, *cut.spread], "int"), "range")
    turn = F.when(F.col("begins"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), spread).cast("int")).otherwise(spread - 1)
    placed = placed.select((F.get(listed(firsts, "int"), "range") + turn).alias("part"), "doc_id", "text", F.lit(False).alias("extra"), (turn < spread - 1).alias("alike"), "begins", "key")

    def nexts(source: DataFrame, wanted: list[tuple[str, int]]) -> DataFrame:
        """One row of each wanted key for the part before it."""
        small = spark.createDataFrame(wanted, "begin string, part int")
        met = source.withColumn("key", key).join(F.broadcast(small), F.col("key") == F.col("begin"))
        return met.groupBy("part").agg(F.min(F.struct("text", "doc_id", "key")).alias("row"))

    wanted = [(k, cut.last_part(i)) for i, k in enumerate(cut.begins)]
    seldom, often = ([w for w, n in zip(wanted, cut.spread, strict=True) if (n > 1) == hot] for hot in (False, True))
    begin = rows.where(F.col("doc_id").eqNullSafe(F.lit(stats.top).cast("long"))).agg(F.min(F.struct(key.alias("key"), "text", "doc_id")).alias("row"))
    extras = begin.where("row is not null").select(F.lit(parts - 1).alias("part"), F.struct("row.text", "row.doc_id", "row.key").alias("row"))
    for source, some in ((rows, seldom), (sample, often)):
        if some:
            extras = extras.unionByName(nexts(source, some))
    extras = extras.select("part", "row.doc_id", "row.text", F.lit(True).alias("extra"), F.lit(False).alias("alike"), F.lit(False).alias("begins"), "row.key")
    return placed.unionByName(extras).repartitionById(parts, "part").sortWithinPartitions("part", "extra", "key", "text").drop("key")


def edited_likeness(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited text and its likeness to both neighbours.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next);
    the edit replaces the last half by the beginning of the successor.
    """
    schema = T.StructType.fromDDL(
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    arrow = to_arrow_schema(schema)

    def row(doc_id, text, mark, after, after_mark):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        at, hashes = fingerprint(edited, k, window)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        return doc_id, len(text), sha, as_text(*mark[:2]), as_text(at, hashes), likeness(mark[2], np.unique(hashes)), likeness(mark[2], after_mark[2])

    def run(batches):
        last = None

        def ended():
            """A part is over: its last row was an extra one, or is followed by one like itself."""
            if last is None or last[4]:
                return []
            if not last[5]:
                raise RuntimeError(f"part {last[0]} lacks the row after its last one")
            return [row(last[1], last[2], last[3], last[2], last[3])]

        for batch in sliced(batches):
            out = []
            for part, doc_id, text, extra, alike, begins in zip(
                batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), texts(batch), *(batch.column(c).to_pylist() for c in ("extra", "alike", "begins")), strict=True
            ):
                at, hashes = fingerprint(text, k, window)
                mark = at, hashes, np.unique(hashes)
                if last is not None and last[0] == part:
                    out.append(row(last[1], last[2], last[3], text, mark))
                else:
                    out += ended()
                    if part and not begins:
                        raise RuntimeError(f"part {part} lacks the row that it begins with")
                last = part, doc_id, text, mark, extra, alike
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        out = ended()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return with_successor(docs, id_col, text_col).mapInArrow(run, schema)

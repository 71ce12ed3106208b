"""Maximal periodic runs of words, by the runs theorem.

Every run has a Lyndon root that is the longest Lyndon word at its position, in the
words' order or in the reversed one. The longest Lyndon word at i ends before the
next position whose suffix is smaller (in the reversed order: larger), so both follow
from the next smaller and next larger values of the inverse suffix array. Each root
is then extended to both sides: to the right by the longest common prefix of the
suffixes at i and i + q, a range minimum of the LCP array from a sparse table; to the
left by bisection over such common prefixes.

The texts of a batch are one array of word numbers with a mark of its own after each
text, so nothing is found across texts, and all steps are numpy operations over the
batch. The suffix array comes from prefix doubling, where only suffixes that aren't
told apart yet are sorted again. A task needs about 150 bytes for each word of a
batch (``batches.SLICE`` bytes of texts, or its longest text). Nothing is shuffled.

Cases: null, empty and blank texts have no words, no run and the digest of the empty
string. A null id counts as one that leaves its text as it is. Repeated rows are rows
of their own; an empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import mapped

#: Least length of a run, and least number of its periods.
LEAST, PERIODS = 6, 4


class Suffixes:
    """Ranks of the suffixes of an array whose last item occurs once, and their common prefixes."""

    def __init__(self, items: np.ndarray) -> None:
        n = len(items)
        levels = [_class_starts(items)]
        rank, size = levels[0], 1
        open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        while len(open_):
            key = rank[open_].astype(np.int64) * n + rank[open_ + size]
            order = np.argsort(key, kind="stable")
            open_, key = open_[order], key[order]
            old = rank[open_]
            place = np.arange(len(open_))
            begin = np.maximum.accumulate(np.where(np.diff(old, prepend=-1) != 0, place, 0))
            new = np.diff(key, prepend=-1) != 0
            first = np.maximum.accumulate(np.where(new, place, 0))
            rank = rank.copy()
            rank[open_] = old + (first - begin)
            levels.append(rank)
            alone = new & np.append(new[1:], True)
            open_, size = open_[~alone], size * 2
        self.rank = rank
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        a, b = order[:-1].copy(), order[1:].copy()
        lcp = np.zeros(n, np.int32)
        for j in range(len(levels) - 1, -1, -1):
            step = (levels[j][a] == levels[j][b]).astype(np.int64) << j
            a += step
            b += step
        lcp[1:] = a - order[:-1]
        self.minima = _minima(lcp)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and at b, other positions."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        j = _log2(high - low + 1)
        return np.minimum(self.minima[j, low], self.minima[j, high - (1 << j) + 1]).astype(np.int64)


def _class_starts(items: np.ndarray) -> np.ndarray:
    """How many items are smaller than each."""
    n = np.bincount(items)
    return (np.cumsum(n) - n)[items].astype(np.int32)


def _log2(n: np.ndarray) -> np.ndarray:
    """Largest j with 2**j <= n, for n >= 1."""
    return np.frexp(n.astype(np.float64))[1] - 1


def _minima(values: np.ndarray) -> np.ndarray:
    """(levels, n): the smallest of 2**level values from each position on (of fewer at the end)."""
    n = len(values)
    out = np.empty((max(1, int(n).bit_length()), n), values.dtype)
    out[0] = values
    for j in range(1, len(out)):
        half = 1 << (j - 1)
        out[j] = out[j - 1]
        np.minimum(out[j - 1, : n - half], out[j - 1, half:], out=out[j, : n - half])
    return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """The next position with a smaller value, or n."""
    n = len(values)
    minima = _minima(values)
    at = np.arange(1, n + 1)
    for j in range(len(minima) - 1, -1, -1):
        row = np.append(minima[j], np.iinfo(values.dtype).min)
        fits = (at + (1 << j) <= n) & (row[np.minimum(at, n)] > values)
        at[fits] += 1 << j
    return at


def runs(items: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs of at least ``periods`` (2 or more) periods and
    ``least`` items, by start and period. The last item occurs once."""
    n = len(items)
    suffixes = Suffixes(items)
    start, period = [], []
    for rank in (suffixes.rank, -suffixes.rank):
        size = next_smaller(rank) - np.arange(n)
        i = np.flatnonzero(np.arange(n) + size * (periods - 1) < n)
        q = size[i]
        again = items[i] == items[i + q]
        start.append(i[again])
        period.append(q[again])
    i, q = np.concatenate(start), np.concatenate(period)
    after = suffixes.common(i, i + q)
    enough = after >= (periods - 2) * q + 1  # less than a period can be missing before the first root
    i, q, end = i[enough], q[enough], (i + q + after)[enough]
    order = np.lexsort((i, q, end))
    i, q, end = i[order], q[order], end[order]
    first = (np.diff(end, prepend=-1) != 0) | (np.diff(q, prepend=-1) != 0)
    i, q, end = i[first], q[first], end[first]
    low, high = np.zeros(len(i), np.int64), np.minimum(q - 1, i)
    while (low < high).any():
        half = (low + high + 1) // 2
        same = suffixes.common(i - half, i + q - half) >= half
        low, high = np.where(same, half, low), np.where(same, high, half - 1)
    i = i - low
    whole = end - i >= np.maximum(least, periods * q)
    i, q, end = i[whole], q[whole], end[whole]
    order = np.lexsort((q, i))
    return i[order], (end - i)[order], q[order]


def repeated_tail(n: int, h: int) -> np.ndarray | None:
    """Which of n words stands at each place once the text's tail repeats, or None where the hash h leaves it as it is."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


@dataclass
class Found:
    """A text's words after the edit, its runs and the words that stay once repetitions are dropped."""

    words: list[bytes]
    runs: list[tuple[int, int, int]]
    kept: list[bytes]


def found_in(texts: list[bytes], ids: list[int | None] | None = None, least: int = LEAST, periods: int = PERIODS) -> list[Found]:
    """The runs of each text; with ``ids``, of the text that the id's hash makes of it."""
    if not texts:
        return []
    numbers: dict[bytes, int] = {}
    words, parts = [], []
    for k, text in enumerate(texts):
        mine = text.split()
        edit = None if ids is None or ids[k] is None else repeated_tail(len(mine), zlib.crc32(str(ids[k]).encode()))
        if edit is not None:
            mine = [mine[j] for j in edit.tolist()]
        words.append(mine)
        parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in mine), np.int64, len(mine)))
    sizes = np.array([len(p) for p in parts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    items = np.empty(int((sizes + 1).sum()), np.int64)
    for k, part in enumerate(parts):
        items[begin[k] : begin[k] + sizes[k]] = part + len(parts)
        items[begin[k] + sizes[k]] = k  # marks come before all words
    start, length, period = runs(items, least, periods)
    steps = np.zeros(len(items) + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + length, -1)
    stays = np.cumsum(steps) == 0
    cut = np.searchsorted(start, np.append(begin, len(items)))
    out = []
    for k, mine in enumerate(words):
        at = slice(cut[k], cut[k + 1])
        mine_runs = list(zip((start[at] - begin[k]).tolist(), length[at].tolist(), period[at].tolist(), strict=True))
        kept = mine if not mine_runs else [w for w, s in zip(mine, stays[begin[k] : begin[k] + sizes[k]].tolist(), strict=True) if s]
        out.append(Found(mine, mine_runs, kept))
    return out


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def collapsed(docs: DataFrame, text_col: str = "text", least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """``docs`` whose texts keep one period of every run, their words joined by one space; a text without runs stays as it is."""
    kind = docs.schema

    def run(batches):
        for batch in batches:
            plain = batch.column(text_col).cast(pa.binary()).to_pylist()
            new = [t if not f.runs else b" ".join(f.kept) for t, f in zip(plain, found_in([t or b"" for t in plain], None, least, periods), strict=True)]
            at = batch.schema.get_field_index(text_col)
            text = pa.array([None if t is None else t.decode() for t in new], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), text)

    return docs.mapInArrow(run, kind)


def periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs) of each
    text, a tenth of them with a repeating tail made by the hash of their id."""

    def per_batch(batch):
        ids = batch.column("doc_id").to_pylist()
        rows = []
        for doc_id, f in zip(ids, found_in(_bytes(batch), ids, least, periods), strict=True):
            start, length, period = min(f.runs, key=lambda r: (-r[1], r[0], r[2])) if f.runs else (None,) * 3
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in f.runs)
            rows.append((
                doc_id, len(f.runs), start, length, period, 1000 * length // period if f.runs else None,
                hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(f.kept)).hexdigest(), [dict(zip(("start", "length", "period"), r, strict=True)) for r in f.runs],
            ))
        names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs")
        return dict(zip(names, zip(*rows, strict=True), strict=True))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return mapped(rows, per_batch, f"{schema}, runs array<struct<start: long, length: long, period: long>>")

"""Best-fit packing of documents into sequences, hierarchical over partitions.

1. Every document is tokenized and cut into pieces; only those longer than a
   sequence are cut. A piece as long as a sequence is one.
2. Pieces are sorted by length in each partition and dealt out in turn to groups of
   about ``FAN * OPEN`` bins and at most about ``PIECES`` pieces, so every group has its share of each length, wherever in the
   table it came from. A task packs one group best-fit, longest first. Bins with at
   most ``SLACK`` tokens free are emitted; all the rest, however many, stay open.
3. Open bins become items and are dealt out again. Of two bins of a group one is over
   half full, so at most one a group is not: those all go to the first group, to
   meet each other and its share of the rest. Rounds end after one group, or when one
   merges nothing; what is open then is emitted. A task holds one group, about 150 MB, at
   any input size and any number of pieces in a bin, and every piece ends in exactly one sequence.

Bins carry their pieces along, so nothing is joined. Sequence ids number the rows
of written tables, so a recomputed task gives the same ones.

``slack`` is the loss that a sequence may have by being closed early: at most 8 of
2048 tokens; 0 closes full ones only. A task holds one Arrow batch of texts in parts
of a few MB, and of a long document its ids (4 bytes each) beside the text.

Cases: null or empty text is one piece, the end token alone. A null id stays null.
Rows that repeat are packed each. An empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.batches import mapped, texts
from plumbline.storage import written

LENGTH, SLACK, FAN, OPEN = 2048, 8, 8, 4096
#: Pieces of a group, of about 700 bytes each in a task.
PIECES = 200_000
#: Words of one generation of a task's memory; it holds the last and the present one.
CACHE = 300_000
_END = b"\0\0\0\0"
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_BINS = f"used int, open boolean, pieces array<struct<{_PIECES}, offset long>>"


class WordIds(dict):
    """Words to their ids as little-endian bytes, by the ``tokenizers`` library."""

    _plain = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*").fullmatch
    _words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+").findall

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:  # words in use come back from the last generation
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        ids = self[word] = self._ids(word) if ids is None else ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text. The tokenizer lower-cases, drops white space and splits before it
        merges; for plain characters without one of its own marks that is done here, and each
        word is looked up once."""
        low = text.lower()
        if self._plain(text) and not any(s in low for s in self.special):
            return b"".join(map(self.__getitem__, self._words(low)))
        return self._ids(text)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end token, cut at ``length``."""

    def per_batch(batch):
        encode = word_ids(path).encode
        out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            ids = encode(text) + _END
            for k, at in enumerate(range(0, len(ids), 4 * length)):
                part = ids[at : at + 4 * length]
                for name, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    out[name].append(value)
        return out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(rows, per_batch, _PIECES)


class BestFit:
    """Open bins by free space; each item goes where it leaves the least."""

    def __init__(self, length: int) -> None:
        self.length, self.free, self.sizes = length, {}, 0

    def put(self, used: int, members: list) -> None:
        """Into the fullest bin with room for it, else a bin of its own."""
        fits = self.sizes >> used << used
        if fits:
            room = (fits & -fits).bit_length() - 1
            found = self._taken(room)
            found += members
            self._keep(room - used, found)
        else:
            self._keep(self.length - used, list(members))

    def full(self, slack: int):
        """Takes out the bins with at most ``slack`` free."""
        for room in range(slack + 1):
            while self.sizes >> room & 1:
                yield self.length - room, self._taken(room)

    def rest(self):
        """Takes out all bins, the fullest first."""
        yield from self.full(self.length)

    def _taken(self, room: int) -> list:
        stack = self.free[room]
        found = stack.pop()
        if not stack:
            del self.free[room]
            self.sizes &= ~(1 << room)
        return found

    def _keep(self, room: int, members: list) -> None:
        self.free.setdefault(room, []).append(members)
        self.sizes |= 1 << room


def dealt(items: DataFrame, groups: int, gathered: bool, length: int) -> DataFrame:
    """Rows (used, open, pieces) as ``groups`` partitions, each with its share of every size and the
    fullest first; those up to half a sequence all in the first if ``gathered``."""
    turn = F.pmod(F.monotonically_increasing_id() + F.hash(F.spark_partition_id()), F.lit(groups))
    if gathered:
        turn = F.when(F.col("used") * 2 <= length, 0).otherwise(turn)
    rows = items.sortWithinPartitions("used").withColumn("turn", turn.cast("int"))
    return rows.repartitionById(groups, "turn").drop("turn").sortWithinPartitions(F.desc("used"))


def packed(items: DataFrame, length: int, slack: int) -> DataFrame:
    """Best-fit inside each partition of rows (used, open, pieces)."""
    struct = T.StructType.fromDDL(_BINS)
    arrow = to_arrow_schema(struct)

    def rows(bins, still_open):
        bins = list(bins)
        for _, members in bins:
            at = 0
            for m in members:
                m["offset"] = at
                at += m["length"]
        if bins:
            yield pa.RecordBatch.from_pylist([{"used": u, "open": still_open, "pieces": m} for u, m in bins], arrow)

    def run(batches):
        fit = BestFit(length)
        for batch in batches:
            for used, members in zip(batch.column("used").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                fit.put(used, members)
            yield from rows(fit.full(slack), False)
        yield from rows(fit.rest(), True)

    return items.mapInArrow(run, struct)


def _amount(bins: DataFrame) -> tuple[int, int]:
    """How many bins, and how many pieces in them."""
    n, held = bins.agg(F.count("*"), F.sum(F.size("pieces"))).first()
    return n, held or 0


def sequences(
    docs: DataFrame, path: str, length: int = LENGTH, slack: int = SLACK, fan: int = FAN, keep: int = OPEN, most: int = PIECES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece."""
    cut = written(pieces(docs, path, length, id_col, text_col), "pieces")
    alone = F.array(F.struct("*", F.lit(0).cast("long").alias("offset")))
    bins = cut.select(F.col("length").cast("int").alias("used"), F.lit(True).alias("open"), alone.alias("pieces"))
    done, left = [bins.filter(F.col("used") >= length)], bins.filter(F.col("used") < length)
    first, (count, held) = True, _amount(left)
    while True:
        groups = max(1, -(-count // (fan * keep)), -(-held // most))
        table = written(packed(dealt(left, groups, not first, length), length, slack), "bins")
        done.append(table.filter("not open"))
        left = table.filter("open")
        before, (count, held) = count, _amount(left)
        if groups == 1 or count == before and not first:
            done.append(left)
            break
        first = False
    out = done[0].select("pieces")
    for more in done[1:]:
        out = out.unionByName(more.select("pieces"))
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).select("sequence_id", F.explode("pieces").alias("p")).select("p.*", "sequence_id")

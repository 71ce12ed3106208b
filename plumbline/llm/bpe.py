"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a byte string exactly one token can be the last of the
prefix's encoding: the one that ends there and is compatible with the last token
of what remains before it, where two tokens are compatible when the encoding of
their joined bytes is those two tokens. Storing that token for each prefix gives
the encoding by walking back, makes appends exact (earlier entries never change)
and lets an edit be re-encoded from the edit on, up to where the new entries have
met the old ones for as long as the longest token.

Cases: null or empty text has no tokens. Long pieces cost time in proportion to
their length times the longest token. A task keeps a bounded cache of pieces;
results don't depend on it. Rows that repeat are encoded alike; a null id stays null.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import mapped, texts

#: Pieces that a task remembers before it starts anew; characters whose pieces are learnt together.
CACHE, CHUNK = 1_000_000, 2_000_000


class PrefixTable:
    """The last token of every prefix of a growing byte string."""

    def __init__(self, model: PrefixBPE, data: bytes = b"") -> None:
        self.model, self.data, self.last = model, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extends the string; entries of the old prefixes stay as they are."""
        self.data += more
        self._fill(len(self.last))

    def restart(self, data: bytes) -> None:
        """Another string; entries of the prefix that it shares with the last one are kept."""
        keep, most, old = 0, min(len(data), len(self.data)), self.data
        while keep < most and old[keep] == data[keep]:
            keep += 1
        del self.last[keep + 1 :]
        self.data = data
        self._fill(keep + 1)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Replaces bytes start..end, recomputing only what the edit can change."""
        old, shift, tail = self.last, len(new) - (end - start), end
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1]
        same, longest = 0, self.model.longest
        for i in range(start + 1, len(self.data) + 1):
            self._fill(i, i)
            before = i - shift
            same = same + 1 if before > tail and old[before] == self.last[i] else 0
            if same >= longest:
                self.last += old[before + 1 :]
                break

    def tokens(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i])
            i -= len(self.model.tokens[self.last[i]])
        return out[::-1]

    def _fill(self, start: int, end: int | None = None) -> None:
        data, last, model = self.data, self.last, self.model
        get, known, longest = model.ranks.get, model._fit, model.longest
        for i in range(start, (end or len(data)) + 1):
            for at in range(i - longest if i > longest else 0, i):
                token = get(data[at:i])
                if token is not None:
                    pair = last[at], token
                    if known[pair] if pair in known else model.fit(*pair):
                        last.append(token)
                        break
            else:
                raise ValueError("the ranks lack a byte")


class PrefixBPE:
    """Encoder and decoder for byte strings, each a piece that merges don't leave."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._fit: dict[tuple[int, int], bool] = {}

    def _merged(self, data: bytes) -> list[int]:
        """Encoding of a short string by its definition: lowest-ranked adjacent merge first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [self.ranks.get(parts[i] + parts[i + 1], len(self.ranks) * 2) for i in range(len(parts) - 1)]
            low = min(ranked)
            if low >= len(self.ranks) * 2:
                break
            i = ranked.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def fit(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' bytes is the two tokens; a = -1: nothing before b."""
        known = self._fit.get((a, b))
        if known is None:
            if len(self._fit) > 1_000_000:
                self._fit.clear()
            known = self._merged(self.tokens.get(a, b"") + self.tokens[b]) == [x for x in (a, b) if x >= 0]
            self._fit[a, b] = known
        return known

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else PrefixTable(self, piece).tokens()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class TextBPE(dict):
    """Pieces of texts to ids, remembered for as long as the cache holds."""

    _plain = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ſ]*").fullmatch

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.model = PrefixBPE(ranks)
        self.split = regex.compile(pattern).findall
        # on plain characters the two classes are these ranges, and the standard module is faster
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", "[^\\sA-Za-zÀ-ÖØ-öø-ſ0-9]").replace(r"\p{L}", "[A-Za-zÀ-ÖØ-öø-ſ]").replace(r"\p{N}", "[0-9]")
        self.split_plain = self.split if r"\p" in plain else re.compile(plain).findall
        self.names = {i: str(i) for i in self.model.tokens}

    def _learn(self, pieces: set[str]) -> None:
        """In sorted order, as neighbours share prefixes."""
        table, whole = PrefixTable(self.model), self.model.ranks.get
        for piece in sorted(pieces):
            data = piece.encode()
            token = whole(data)
            if token is None:
                table.restart(data)
                self[piece] = tuple(table.tokens())
            else:
                self[piece] = (token,)

    def _chunk(self, found: list[str]) -> Iterator[list[int]]:
        split = [self.split_plain(t) if self._plain(t) else self.split(t) for t in found]
        pieces = set().union(*split)
        new = pieces - self.keys()
        if len(self) + len(new) > CACHE:
            self.clear()
            new = pieces
        self._learn(new)
        for x in split:
            yield list(chain.from_iterable(map(self.__getitem__, x)))

    def encode(self, found: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each text."""
        some, size = [], 0
        for text in found:
            some.append(text)
            size += len(text)
            if size >= CHUNK:
                yield from self._chunk(some)
                some, size = [], 0
        yield from self._chunk(some)


@lru_cache(maxsize=2)
def text_bpe(path: str, pattern: str) -> TextBPE:
    return TextBPE(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): token ids of each whole text."""

    def per_batch(batch):
        bpe = text_bpe(path, pattern)
        return {"doc_id": batch.column("doc_id"), "ids": list(bpe.encode(texts(batch)))}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(rows, per_batch, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data): bytes of rows (doc_id, ids)."""

    def per_batch(batch):
        decode = text_bpe(path, pattern).model.decode
        return {"doc_id": batch.column("doc_id"), "data": [decode(ids or []) for ids in batch.column("ids").to_pylist()]}

    return mapped(rows, per_batch, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of ids and of the bytes they decode to."""

    def per_batch(batch):
        bpe = text_bpe(path, pattern)
        n, ids_sha, text_sha = [], [], []
        for ids in bpe.encode(texts(batch)):
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(bpe.model.decode(ids)).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(rows, per_batch, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

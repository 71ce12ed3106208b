"""Language identification by a linear-chain CRF over the words of a text.

A word's features are hashed character n-grams of the word between boundary marks
(those that touch a mark are its affixes), and a row for each lexicon word, one
that the training sample has often. The learnt transitions say how seldom the
language changes from word to word; forward-backward gives every word of a text
its posterior over languages, also where languages are mixed. The document's
language has the largest mean posterior, which is the score.

Training is on the driver, from at most ``per_label`` labelled documents a language
of at most ``SAMPLE_BYTES`` each (longer ones aren't learnt from), ``SAMPLE`` documents
and ``ALL_BYTES`` in all (the sample bound; those with the smallest hash of their id), cut
into short runs that are spliced, so that changes of language are seen. Rows that repeat
id, text and language count once, so however many there are, the driver gets one.

Cases: null text, or a text without a letter, is ``und`` with score 0. Without
labelled rows every document is ``und``. Null languages aren't learnt. A null id is
held in. Ties go to the language first in order. Rows that repeat are predicted
alike; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm import crf
from plumbline.llm.batches import mapped, sliced, texts

NONE = "und"
#: Bounds of the training sample: documents a language, documents in all, bytes of a document (longer
#: ones aren't taken), words in all, and bytes of all documents, which is what the driver can hold of texts.
PER_LABEL, SAMPLE, SAMPLE_BYTES, WORDS, ALL_BYTES = 150, 10_000, 100_000, 120_000, 64_000_000
#: Rows of n-grams, and characters of texts that are scored together.
GRAM_ROWS, CHUNK = 1 << 16, 400_000
_alphanumeric = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode's category L), lower-cased; signs such as ``½``, ``²`` or ``Ⅷ`` are none."""
    found = _alphanumeric(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in ("".join(c if c.isalpha() else " " for c in x)).split()]


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, starts): the hashed 2- and 3-grams of each word, and 4-grams that touch its ends."""
    points = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), np.uint32).astype(np.uint64)
    mark = points == 10
    word = np.cumsum(mark) - 1
    found, owner = [], []
    for size in (2, 3, 4):
        n = len(points) - size + 1
        if n <= 0:
            continue
        h = np.full(n, size, np.uint64)
        for j in range(size):
            h = (h + points[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        inner = np.zeros(n, bool)
        for j in range(1, size - 1):
            inner |= mark[j : j + n]
        good = ~inner & ~(mark[:n] & mark[size - 1 : size - 1 + n] & (size == 2))
        if size == 4:
            good &= mark[:n] | mark[3 : 3 + n]
        found.append((h[good] >> np.uint64(16)).astype(np.int64) % GRAM_ROWS)
        owner.append(word[:n][good])
    rows, owners = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return rows[order], np.searchsorted(owners[order], np.arange(len(words)))


@dataclass
class Model:
    """Languages, lexicon (word to row), weights of grams and lexicon, transitions."""

    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, languages) of distinct words."""
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        out = crf.scores(self.weights, *gram_rows(words))
        at = [(i, self.lexicon[w]) for i, w in enumerate(words) if w in self.lexicon]
        if at:
            i, row = np.array(at).T
            out[i] += self.weights[row]
        return out

    def predict(self, found: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        return self.judged(found)[:2]

    def judged(self, found: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language and score of each text, and how sure its words are of theirs: the mean of each
        word's largest posterior, which a text of several languages has high as well."""
        langs, scores, sure = [], [], []
        some, size = [], 0
        for text in found:
            some.append(text)
            size += len(text)
            if size >= CHUNK:
                self._judge(some, langs, scores, sure)
                some, size = [], 0
        self._judge(some, langs, scores, sure)
        return langs, scores, sure

    def _judge(self, found: list[str], langs: list[str], scores: list[float], sure: list[float]) -> None:
        split = [words_of(t) for t in found]
        lengths = np.array([len(x) for x in split], np.int64)
        names = dict.fromkeys(w for x in split for w in x)
        for i, w in enumerate(names):
            names[w] = i
        by_word = self.word_scores(list(names))
        at = np.fromiter((names[w] for x in split for w in x), np.int64, int(lengths.sum()))
        first = np.zeros(len(at), bool)
        full = np.flatnonzero(lengths)
        starts = (np.cumsum(lengths) - lengths)[full]
        first[starts] = True
        mean, own = np.zeros((len(found), max(1, len(self.labels)))), np.zeros(len(found))
        if len(at) and self.labels:
            p = crf.posteriors(by_word[at], self.transitions, first)
            mean[full] = np.add.reduceat(p, starts, axis=0) / lengths[full][:, None]
            own[full] = np.add.reduceat(p.max(axis=1), starts) / lengths[full]
        best = mean.argmax(axis=1)
        for i, k in enumerate(best):
            known = bool(lengths[i]) and bool(self.labels)
            langs.append(self.labels[k] if known else NONE)
            scores.append(min(1.0, float(mean[i, k])) if known else 0.0)
            sure.append(float(own[i]))


def train(samples: dict[str, list[str]], words: int = WORDS) -> Model:
    """A model from texts by language; ``words`` bounds the tokens of training."""
    labels = sorted(samples)
    streams = [np.array([w for t in samples[x] for w in words_of(t)] or ["\0"], object) for x in labels]
    counts: dict[str, int] = {}
    for s in streams:
        for w in s:
            counts[w] = counts.get(w, 0) + 1
    lexicon = {w: GRAM_ROWS + i for i, w in enumerate(sorted(w for w, n in counts.items() if n >= 10))}
    rng = np.random.default_rng(0)
    tokens, y, first = [], [], []
    while labels and len(tokens) < words:
        k, end = int(rng.integers(len(labels))), len(tokens) + 40
        first.append(len(tokens))
        while len(tokens) < end:
            size = min(int(rng.geometric(1 / 25)), end - len(tokens))
            start = int(rng.integers(max(1, len(streams[k]) - size + 1)))
            run = streams[k][start : start + size]
            tokens += list(run)
            y += [k] * len(run)
            k = int(rng.integers(len(labels)))
    names = {w: i for i, w in enumerate(dict.fromkeys(tokens))}
    flat, starts = gram_rows(list(names)) if names else (np.empty(0, np.int64), np.empty(0, np.int64))
    of_word = np.split(flat, starts[1:])
    of_word = [np.append(r, lexicon[w]) if w in lexicon else r for r, w in zip(of_word, names, strict=False)]
    marks = np.zeros(len(tokens), bool)
    marks[first] = True
    size = GRAM_ROWS + len(lexicon)
    weights, transitions = crf.trained([of_word[names[w]] for w in tokens], np.array(y, np.int64), marks, size, len(labels)) if tokens else (np.zeros((size, 0)), np.zeros((0, 0)))
    return Model(labels, lexicon, weights.astype(np.float32), transitions)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from at most ``per_label`` labelled documents of each language that aren't held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES))
    rows = rows.withColumns({"mark": F.xxhash64("text"), "size": F.octet_length("text")})
    chance = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "mark")
    ranked = rows.select("lang", "doc_id", "mark", "size", F.dense_rank().over(chance).alias("k")).filter(F.col("k") <= per_label).distinct()
    first = ranked.orderBy("k", "lang", "doc_id", "mark").limit(SAMPLE).collect()  # SAMPLE rows without texts
    total, wanted = 0, []
    for r in first:
        total += r.size
        if total > ALL_BYTES:
            break
        wanted.append((r.lang, r.doc_id, r.mark))
    if not wanted:
        return train({})
    chosen = docs.sparkSession.createDataFrame(wanted, ranked.select("lang", "doc_id", "mark").schema).toDF("l", "d", "m")
    same = (F.col("lang") == F.col("l")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))
    met = rows.join(F.broadcast(chosen), same).groupBy("lang", "doc_id", "mark").agg(F.min("text").alias("text"))  # of equal rows one
    samples: dict[str, list[str]] = {}
    for r in met.orderBy("lang", "doc_id", "text").collect():  # at most SAMPLE rows of ALL_BYTES together
        samples.setdefault(r.lang, []).append(r.text)
    return train(samples)


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: GRAM_ROWS and the lexicon of a bounded sample

    def per_batch(batch):
        langs, scores = shared.value.predict(texts(batch))
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": langs, "score": scores}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return mapped(rows, per_batch, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, min_sure: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have a language, of words that are sure of theirs by ``min_sure``, all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded as above
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in sliced(batches):
            langs, _, sure = shared.value.judged([x or "" for x in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([a != NONE and s >= min_sure for a, s in zip(langs, sure, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

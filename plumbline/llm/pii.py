"""Personal data in texts: fixed patterns, and a linear-chain CRF for what has no pattern.

The patterns (email, ip, card, phone) are matched leftmost and without overlap,
each kind by itself; a match that fails its check is dropped. Every pattern runs
in time linear in the text. The CRF labels the tokens of a line from their word
shapes, lengths and small lexicons: secrets, names, dates of birth, national ids and
IBANs that a word announces, and street addresses. It is trained from a small table
of lines made by rule, and decoded by Viterbi in numpy batches. A value has a cue
and an address a street word: steps between labels that say otherwise are barred, so
lines without such a word need no decoding. What is found is added whole, whatever
spans of patterns it overlaps; redaction replaces spans that overlap as one.

Cases: null or empty text has no spans. Texts of any length are read whole, tokens
line by line. A null id stays null. Rows that repeat get the same answer. An empty
table gives an empty result. Extra columns are read by ``redacted`` only.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import crf
from plumbline.llm.batches import mapped, texts
from plumbline.llm.pii_samples import BETWEEN, CUES, LEARNT, MONTHS, STREETS, labelled_lines

KINDS = ("email", "ip", "card", "phone", *LEARNT)
Span = tuple[int, int, int]  # start, kind, end

_local = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_digit = re.compile(r"[0-9]").search
# a run of digits that fails from its first digit fails from the rest, so starts inside runs are passed over
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_card = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++").finditer
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_not_local = re.compile(r"[^A-Za-z0-9._%+-]")


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of ``local@domain``: what is before an ``@`` as far as it may reach, and the domain after it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and not _not_local.match(text, start - 1):
            start -= 1
        found = _domain.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def pattern_spans(text: str) -> list[Span]:
    """The fixed patterns' spans, by start and kind."""
    out = [(s, 0, e) for s, e in emails(text)]
    if _digit(text):
        out += [(m.start(), 1, m.end()) for m in _ip(text) if all(map(_small, m[0].split(".")))]
        for m in _card(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _phone(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# ---- the CRF -------------------------------------------------------------------------------

#: Labels: none of these; for each kind a cue, what is between, and the value; of an address what is before its street word, that, and after it.
_KIND_LABELS = {k: (3 * i + 1, 3 * i + 2, 3 * i + 3) for i, k in enumerate(LEARNT)}
OTHER, LABELS = 0, 3 * len(LEARNT) + 1
#: What bars a label: enough to train with; when decoding, more than any path can gain.
_BARRED, _NEVER = -40.0, -1e12
_token = re.compile(r"[^\W_]+|[^\w\s]|_")
_words = re.compile(r"[^\W_]+").findall
_hex = re.compile(r"[0-9a-f]+\Z").match
_LENGTHS = (1, 2, 4, 7, 11, 15, 23, 39)
#: Every path that leaves "none" passes one of these words, so a line without any has no span.
TRIGGERS = STREETS.union(*CUES.values())
_LEXICON = TRIGGERS | MONTHS | BETWEEN
#: Texts of so many tokens' lines are decoded together; tokens that a task remembers.
DECODED, REMEMBERED = 20_000, 50_000


def _of(kind: str) -> tuple[int, int, int]:
    return _KIND_LABELS[kind]


def allowed_steps() -> np.ndarray:
    """(labels, labels): 0 where one label may follow another, else large and negative.

    A cue leads to its own value, through what is between. An address has a street
    word. Values end anywhere.
    """
    out = np.full((LABELS, LABELS), _BARRED)
    starts, ends = [OTHER], [OTHER]
    for kind in LEARNT:
        a, b, c = _of(kind)
        if kind == "address":  # before, street word, after
            starts, ends = [*starts, a, b], [*ends, b, c]
            follow = {a: (a, b), b: (b, c), c: (c,)}
        else:
            starts, ends = [*starts, a], [*ends, c]
            follow = {a: (a, b, c), b: (b, c), c: (c,)}
        for x, ys in follow.items():
            out[x, list(ys)] = 0
    out[np.ix_(ends, starts)] = 0
    return out


def token_features(token: str) -> tuple[str, ...]:
    """A token's features: itself if punctuation, else its shape, length class and lexicon word."""
    if not token:
        return ("edge",)
    if not token[0].isalnum():
        return "any", "mark", f"mark {token}"
    length = bisect.bisect_left(_LENGTHS, len(token))
    if token.isalpha():
        shape = "lower" if token.islower() else "upper" if token.isupper() and length else "title" if token[0].isupper() else "inner"
    elif token.isdigit():
        shape = "digits"
    else:
        shape = "hex" if _hex(token) else "upper code" if token.upper() == token else "mixed"
    word = token.lower()
    return ("any", shape, f"{shape} {length}", f"word {word}") if word in _LEXICON else ("any", shape, f"{shape} {length}")


def token_bars(token: str) -> np.ndarray:
    """0 for the labels that a token may have, else large and negative: cues and street words are
    of the lexicon, a line's edges (empty tokens) have no label."""
    out = np.zeros(LABELS)
    word = token.lower()
    for kind in LEARNT:
        a, b, _ = _of(kind)
        if kind == "address":
            out[b] = 0 if word in STREETS else _BARRED
        else:
            out[a] = 0 if word in CUES[kind] else _BARRED
    if not token:
        out[1:] = _BARRED
    return out


def line_tokens(line: str, at: int = 0) -> list[tuple[str, int, int]]:
    """(token, start, end) of a line between its two edges."""
    return [("", at, at), *((m[0], at + m.start(), at + m.end()) for m in _token.finditer(line)), ("", at + len(line), at + len(line))]


def line_labels(tokens: list[tuple[str, int, int]], spans: list[tuple[int, str, int]]) -> list[int]:
    """Labels of a labelled line's tokens."""
    out = [OTHER] * len(tokens)
    for start, kind, end in spans:
        first, middle, value = _of(kind)
        inside = [i for i, (t, s, e) in enumerate(tokens) if t and start <= s and e <= end]
        if kind == "address":
            street = next(i for i in inside if tokens[i][0].lower() in STREETS)
            for i in inside:
                out[i] = first if i < street else middle if i == street else value
        else:
            cue = next(i for i in range(inside[0] - 1, 0, -1) if tokens[i][0].lower() in CUES[kind])
            out[cue] = first
            out[cue + 1 : inside[0]] = [middle] * (inside[0] - cue - 1)
            for i in inside:
                out[i] = value
    return out


@dataclass(frozen=True)
class Model:
    """Rows of the features, weights and transitions of the CRF."""

    at: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray

    def score(self, token: str) -> np.ndarray:
        return np.where(token_bars(token) < 0, _NEVER, 0) + sum((self.weights[self.at[f]] for f in token_features(token) if f in self.at), np.zeros(LABELS))


@lru_cache(maxsize=1)
def trained() -> Model:
    """The CRF of the labelled table."""
    tokens, labels, first = [], [], []
    for line, spans in labelled_lines():
        found = line_tokens(line)
        first.append(len(tokens))
        tokens += [t for t, _, _ in found]
        labels += line_labels(found, spans)
    at = {f: i for i, f in enumerate(sorted({f for t in tokens for f in token_features(t)}))}
    start = np.zeros(len(tokens), bool)
    start[first] = True
    rows = [np.array([at[f] for f in token_features(t)]) for t in tokens]
    bars = np.array([token_bars(t) for t in tokens])
    weights, transitions = crf.trained(rows, np.array(labels), start, len(at), LABELS, rounds=16, batch=400, rate=0.15, decay=1e-4, barred=bars, steps=allowed_steps())
    return Model(at, weights, np.where(allowed_steps() < 0, _NEVER, transitions))


class Finder:
    """Spans of one task's texts; remembers the scores of tokens it has seen."""

    def __init__(self, model: Model) -> None:
        self.model, self.seen = model, {}

    def score(self, token: str) -> np.ndarray:
        if token not in self.seen:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[token] = self.model.score(token)
        return self.seen[token]

    def learnt(self, found: list[str]) -> list[list[Span]]:
        """Spans that the CRF finds in each text."""
        out: list[list[Span]] = [[] for _ in found]
        lines, size = [], 0
        for k, text in enumerate(found):
            if TRIGGERS.isdisjoint(_words(text.lower())):
                continue
            at = 0
            for line in text.split("\n"):
                if not TRIGGERS.isdisjoint(_words(line.lower())):
                    lines.append((k, line_tokens(line, at)))
                    size += len(lines[-1][1])
                    if size >= DECODED:
                        self._decode(lines, out)
                        lines, size = [], 0
                at += len(line) + 1
        if lines:
            self._decode(lines, out)
        return out

    def _decode(self, lines: list[tuple[int, list[tuple[str, int, int]]]], out: list[list[Span]]) -> None:
        score = np.array([self.score(t) for _, line in lines for t, _, _ in line])
        best = crf.viterbi(score, self.model.transitions, np.array([len(x) for _, x in lines])).tolist()
        i = 0
        for k, line in lines:
            run = None
            for _, start, end in line:
                kind = _SPAN_KIND.get(best[i])
                if run and kind == run[1]:
                    run = run[0], kind, end
                else:
                    if run:
                        out[k].append(run)
                    run = (start, kind, end) if kind is not None else None
                i += 1

    def spans(self, found: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """(pattern spans, all spans) of each text, by start and kind."""
        return [(base := pattern_spans(text), sorted(base + more)) for text, more in zip(found, self.learnt(found), strict=True)]


#: The kinds of labels that belong to a span.
_SPAN_KIND = {label: KINDS.index(k) for k in LEARNT for label in (_of(k) if k == "address" else _of(k)[2:])}


def all_spans(found: list[str], model: Model | None = None) -> list[tuple[list[Span], list[Span]]]:
    """(pattern spans, all spans) of each text, by start and kind."""
    return Finder(model or trained()).spans(found)


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def found_in(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans): pattern counts and digest, all spans and their number."""

    shared = docs.sparkSession.sparkContext.broadcast(trained())  # weights of the labelled table's features

    def per_batch(batch):
        names = ("n_email", "n_ip", "n_card", "n_phone")
        out = {n: [] for n in (*names, "base_sha256", "spans", "n_spans")}
        for base, spans in all_spans(texts(batch), shared.value):
            for k, n in enumerate(names):
                out[n].append(sum(x[1] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(spans_text(base).encode()).hexdigest())
            out["spans"].append(spans_text(spans))
            out["n_spans"].append(len(spans))
        return {"doc_id": batch.column("doc_id")} | out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(rows, per_batch, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones together, replaced by its first kind in brackets."""
    out, last = [], 0
    for start, kind, end in spans:
        if start >= last:
            out += [text[last:start], f"[{KINDS[kind].upper()}]"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with spans replaced in the text, and its length in ``length_col`` if named; other columns as they are."""
    schema = docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(trained())  # as above

    def per_batch(batch):
        at = batch.schema.get_field_index(text_col)
        found = batch.column(at).to_pylist()
        new = [x and redact(x, spans) for x, (_, spans) in zip(found, all_spans([x or "" for x in found], shared.value), strict=True)]
        out = {n: batch.column(i) for i, n in enumerate(batch.schema.names)} | {text_col: new}
        if length_col:
            out[length_col] = [None if x is None else len(x) for x in new]
        return out

    return mapped(docs, per_batch, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))

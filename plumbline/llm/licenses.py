"""License scans by template-markup matching.

A template (``license_texts``) is compiled into a token automaton. Its states are the
tokens; a token takes one word: a fixed one, one of a choice, or any. From a state the
automaton goes to the next token, and past every optional region that begins there; a
replaceable region of up to n words is n tokens that take any word, each of which may
be the last. The states that are reached are the bits of one integer, so a word is one
look-up and one step for each state that took it. A text is accepted from a word on
where all mandatory wording stands in its order, exactly, with nothing between but
what the regions allow.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. The
automata start only at words that begin a template; the rest of a text costs one look-up
a word. Templates and phrases are a fixed small table that goes with the task; nothing
is shuffled, and a task holds a few MB of texts, besides its longest one.

Cases: null counts as empty, and has no words, no labels and score 0. Equal rows have
equal results; an empty table gives an empty one. Texts of any length are read whole.
Matches may overlap; of those of one template that begin at one word the longest counts.
Extra columns aren't read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import license_texts
from plumbline.llm.batches import mapped

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_PART = re.compile(r"(\[\[|\]\]|<<[^<>:]*:\d+>>|\{\{[^{}]*\}\})")


def words_of(text: str | bytes) -> list[bytes]:
    """The text's words; lower-casing bytes changes A-Z alone."""
    return _WORD.findall((text.encode() if isinstance(text, str) else text).lower())


@dataclass
class Automaton:
    """A compiled template: ``after[i]`` has the bits of the states that follow token i, the last bit accepts."""

    first: int
    takes: dict[bytes, int]
    takes_any: int
    after: list[int]
    starts: set[bytes] = field(default_factory=set)

    def end(self, words: list[bytes], at: int) -> int | None:
        """Where the longest match that begins at a word ends, or None."""
        accepts, active, found = 1 << len(self.after), self.first, None
        for j in range(at, len(words) + 1):
            if active & accepts:
                found = j
            if j == len(words):
                break
            took = active & (self.takes.get(words[j], 0) | self.takes_any)
            active = 0
            while took:
                bit = took & -took
                active |= self.after[bit.bit_length() - 1]
                took ^= bit
            if not active:
                break
        return found


def compiled(template: str) -> Automaton:
    """The automaton of a template; ValueError where its regions don't nest or it doesn't begin with a word."""
    tokens: list[set[bytes] | None] = []  # None takes any word
    skips: list[tuple[int, int]] = []
    opened: list[int] = []
    for part in _PART.split(template):
        if part == "[[":
            opened.append(len(tokens))
        elif part == "]]":
            if not opened:
                raise ValueError("a region ends that hasn't begun")
            skips.append((opened.pop(), len(tokens)))
        elif part.startswith("<<"):
            n = int(part[:-2].rsplit(":", 1)[1])
            skips += [(len(tokens) + k, len(tokens) + n) for k in range(n)]
            tokens += [None] * n
        elif part.startswith("{{"):
            tokens.append({w for choice in part[2:-2].split("|") for w in words_of(choice)})
        else:
            tokens += [{w} for w in words_of(part)]
    if opened:
        raise ValueError("a region doesn't end")
    ways = defaultdict(list)
    for a, b in skips:
        ways[a].append(b)
    reach = [0] * len(tokens) + [1 << len(tokens)]
    for i in range(len(tokens) - 1, -1, -1):
        reach[i] = 1 << i
        for b in ways[i]:
            reach[i] |= reach[b] if b > i else 0
    takes: dict[bytes, int] = defaultdict(int)
    takes_any = 0
    for i, token in enumerate(tokens):
        if token is None:
            takes_any |= 1 << i
        for w in token or ():
            takes[w] |= 1 << i
    if reach[0] & (takes_any | 1 << len(tokens)):
        raise ValueError("a template begins with a mandatory word")
    starts = {w for w, states in takes.items() if states & reach[0]}
    return Automaton(reach[0], dict(takes), takes_any, reach[1:], starts)


class Scanner:
    """All phrases and templates, by the words that they begin with."""

    def __init__(self, phrases: list[tuple[str, str]] = license_texts.PHRASES, templates: list[tuple[str, str]] = license_texts.TEMPLATES) -> None:
        self.by_word: dict[bytes, tuple[list, list]] = defaultdict(lambda: ([], []))
        for phrase, label in phrases:
            mandatory = words_of(phrase)
            self.by_word[mandatory[0]][0].append((mandatory, label))
        for label, template in templates:
            automaton = compiled(template)
            for w in automaton.starts:
                self.by_word[w][1].append((automaton, label))
        self.by_word = dict(self.by_word)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(places of phrases, matches of templates) as (label, first word, word after the last), by first word."""
        places, matches = [], []
        by_word = self.by_word
        for i in [i for i, w in enumerate(words) if w in by_word]:
            phrases, automata = by_word[words[i]]
            places += [(label, i, i + len(p)) for p, label in phrases if words[i : i + len(p)] == p]
            matches += [(label, i, end) for a, label in automata if (end := a.end(words, i)) is not None]
        return places, matches


def scanned(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list[tuple[str, str]] = license_texts.PHRASES, templates: list[tuple[str, str]] = license_texts.TEMPLATES
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) of each text.

    The base is the phrases' places; ``labels`` has the templates' as well. ``score`` is 1 where a
    template's whole wording stands in the text, 0.5 where only a phrase does, else 0.
    """
    scanner = Scanner(phrases, templates)

    def per_batch(batch):
        out = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            words = words_of(text or b"")
            places, matches = scanner.scan(words)
            base, more = {p[0] for p in places}, {m[0] for m in matches}
            at = [p[1] for p in places]
            score = 1.0 if more else 0.5 if base else 0.0
            spans = [dict(zip(("label", "start", "end"), m, strict=True)) for m in matches]
            out.append((doc_id, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score, spans))
        names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")
        return dict(zip(names, zip(*out, strict=True), strict=True))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return mapped(rows, per_batch, f"{schema}, matches array<struct<label: string, start: int, end: int>>")


def as_regex(template: str) -> str:
    """The template as a regular expression over words with a blank before each, for engines that have those alone."""
    out = []
    for part in _PART.split(template):
        if part in ("[[", "]]"):
            out.append("(?:" if part == "[[" else ")?")
        elif part.startswith("<<"):
            out.append("(?: [^ ]+){0,%d}" % int(part[:-2].rsplit(":", 1)[1]))
        elif part.startswith("{{"):
            out.append(f" (?:{part[2:-2]})")
        else:
            out += [" " + w.decode() for w in words_of(part)]
    return "".join(out)

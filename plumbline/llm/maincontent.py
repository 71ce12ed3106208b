"""Main text of web pages by a minimum cut between content and boilerplate.

A page's blocks are the runs of text between block-level tags. A logistic
classifier, trained from labelled pages made by rule, gives each block a cost of
being content and of being boilerplate: its capacities to the two terminals.
Adjacent blocks, and successive blocks of one container, are joined by smoothness
edges, the stronger the closer they are in the tree; how strong is chosen on
labelled pages that the classifier hasn't seen. The minimum cut, found by max-flow,
is the labelling of least total cost, so a doubtful block goes with what surrounds
it. Before that, blocks whose terminal outweighs all their edges are fixed and
their edges folded into the neighbours, which leaves the minimum cut as it is and
the graph small.

Cases: null or empty html has no blocks and an empty text. Tags cut off at the end,
unclosed elements, comments and scripts are tolerated; a page of any length is read
whole. Repeated rows give the same text. A null id stays null. An empty table gives
an empty result. Extra columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import mapped, texts
from plumbline.llm.sample_pages import labelled_page

#: Fixed lists of elements: those that end a block, those whose contents aren't text, those without end tags.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset("script style title template noscript textarea select button svg iframe object canvas audio video".split())
#: Of the hidden ones, those whose contents are not markup: without an end tag they last to the page's end.
RAW = frozenset("script style title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of these is closed by the start of one of the listed. Fixed table.
CLOSES = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"])}

_tag = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_named = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_space = re.compile(r"\s+")
_word = re.compile(r"[a-z]+")

#: Words of class, id and role attributes that name what isn't the article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertisements sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert sidebar aside comment comments commentlist disqus reply replies respond footer header masthead nav navbar navigation menu breadcrumb breadcrumbs share sharing social related recommended popular trending newsletter subscribe subscription signup login popup modal overlay widget toolbar pagination pager copyright search skip".split()
)
CONTENT = frozenset("article content main post entry story body text".split())
KNOWN, KNOWN_NONE = BOILERPLATE | CONTENT, frozenset()
AROUND = frozenset(["nav", "footer", "aside", "form", "menu", "dialog", "fieldset"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Wordings of page furniture, and of the heading of readers' comments, in four languages.
_furniture = re.compile(r"\b(?:cookies?|consent|privacy policy|newsletter|subscribe|sign up|log ?in|advertisement|sponsored|anzeige|werbung|publicit[ée]|publicidad|abonnieren|abonnez|suscr[íi]bete|related|read more|most popular|mehr zum thema|à lire aussi|más noticias)\b", re.I).search
_replies = re.compile(r"(?:\d+ )?(?:readers? )?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)(?: ?\(?\d+\)?)?:?$|(?:leave|post|write) (?:a|your) (?:reply|comment)\b|\d+ repl(?:y|ies)$|schreiben? sie einen kommentar|laisser un commentaire|deja un comentario", re.I).match


class Node:
    """An open element: where it stands in the tree, and what surrounds it."""

    __slots__ = ("depth", "inside", "names", "parent", "replies", "tag")

    def __init__(self, tag: str, parent: Node | None, inside: frozenset[str], names: frozenset[str]) -> None:
        self.tag, self.parent, self.inside, self.names = tag, parent, inside, names
        self.depth: int = parent.depth + 1 if parent else 0
        self.replies: bool = bool(parent and parent.replies)


@dataclass
class Block:
    """A run of text, the element it stands in, the length of its links, whether readers' comments have begun around it."""

    text: str
    node: Node
    linked: int
    replies: bool = False


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order; character references decoded, white space single, trimmed."""
    out: list[Block] = []
    stack = [Node("", None, frozenset(), frozenset())]
    opened: Counter[str] = Counter()
    endless: set[str] = set()
    run: list[str] = []
    linked = 0
    link, at = False, 0

    def close() -> None:
        nonlocal linked, link
        text = _space.sub(" ", "".join(run)).strip()
        if text:
            top = stack[-1]
            if len(text) <= 40 and _replies(text):
                # what follows in a heading's container are readers' words
                top.replies = True
                if top.tag in HEADINGS and top.parent:
                    top.parent.replies = True
            out.append(Block(text, top, linked, top.replies or bool(top.parent and top.parent.replies)))
        run.clear()
        linked, link = 0, False

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            run.append(text)
            if link:
                linked += len(_space.sub(" ", text).strip())

    def pop_to(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    while True:
        found = _tag.search(page, at)
        add(page[at : found.start()] if found else page[at:])
        if not found:
            break
        at = found.end()
        ends, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in HIDDEN:
            if not ends and not attributes.endswith("/"):
                end = None if tag in endless else re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                if not end:
                    endless.add(tag)
                at = end.end() if end else len(page) if tag in RAW else at
            run.append(" ")
        elif tag == "a":
            link = not ends
        elif tag in BLOCK:
            close()
            if ends:
                if opened[tag]:
                    pop_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            elif tag not in VOID:
                while len(stack) > 1 and tag in CLOSES.get(stack[-1].tag, ()):
                    pop_to(len(stack) - 1)
                words = KNOWN.intersection(_word.findall(" ".join("".join(x) for x in _named.findall(attributes)).lower())) if "=" in attributes else KNOWN_NONE
                top = stack[-1]
                stack.append(Node(tag, top, top.inside if tag in top.inside else top.inside | {tag}, top.names if words <= top.names else top.names | words))
                opened[tag] += 1
        elif tag == "br":
            run.append(" ")
    close()
    return out


NAMES = (
    "one", "article", "around", "page header", "named boilerplate", "named content", "links", "length", "stops", "heading", "paragraph", "item", "rights", "edge", "furniture", "replies",
)


def features(blocks: list[Block]) -> np.ndarray:
    """(blocks, features), each about between 0 and 1."""
    rows = []
    for i, b in enumerate(blocks):
        n, node = len(b.text), b.node
        inner = "article" in node.inside or "main" in node.inside
        stops = sum(map(b.text.count, ".,;!?:"))
        rows.append((
            1,
            inner,
            not AROUND.isdisjoint(node.inside),
            "header" in node.inside and not inner,
            not BOILERPLATE.isdisjoint(node.names),
            not CONTENT.isdisjoint(node.names),
            b.linked / n,
            min(1.0, math.log1p(n) / 7),
            min(1.0, 20 * stops / (n + 20)),
            node.tag in HEADINGS,
            node.tag in ("p", "blockquote", "pre"),
            node.tag in ("li", "dt", "dd", "td", "th"),
            "©" in b.text or n < 400 and "all rights reserved" in b.text.lower(),
            i in (0, len(blocks) - 1),
            n < 160 and _furniture(b.text) is not None,
            b.replies,
        ))
    return np.array(rows, float).reshape(-1, len(NAMES))


_MARK = "\ue000"


def labelled(page: str) -> tuple[list[Block], np.ndarray]:
    """The blocks of a page and which of them are content: those of elements with ``data-keep``."""
    marked = blocks_of(re.sub(r"(<\w+) data-keep>", rf"\1>{_MARK}", page))
    keep = np.array([_MARK in b.text for b in marked], bool)
    return [replace(b, text=b.text.replace(_MARK, "").strip()) for b in marked], keep


@dataclass(frozen=True)
class Model:
    """Weights of the classifier (positive: content), and how strong the edges are."""

    weights: np.ndarray
    smooth: float


#: Pages of the labelled table that train the classifier, and those that choose the edges' strength among these.
TRAINING, CHOOSING = range(240), range(240, 360)
STRENGTHS = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0)


def fitted(pages: list[str]) -> np.ndarray:
    """Weights of a logistic classifier by Newton's method."""
    rows, labels = zip(*map(labelled, pages), strict=True)
    x, y = np.concatenate([features(b) for b in rows]), np.concatenate(labels).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(20):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - w)
    return w


def wrong(pages: list[tuple[list[Block], np.ndarray]], model: Model) -> int:
    """How many blocks of labelled pages the model gets wrong."""
    return sum(int(np.count_nonzero(np.array(kept(b, model)) != y)) for b, y in pages if len(b))


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model of the labelled table: of the strengths, the one with the fewest wrong blocks on pages not trained on."""
    weights = fitted([labelled_page(k) for k in TRAINING])
    held = [labelled(labelled_page(k)) for k in CHOOSING]
    return min((Model(weights, s) for s in STRENGTHS), key=lambda m: wrong(held, m))


def _steps(a: Node, b: Node) -> int:
    """Steps in the tree between two elements."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def edges_of(blocks: list[Block], smooth: float = 1.0) -> list[tuple[int, int, float]]:
    """Smoothness edges (i, j, weight): of adjacent blocks, the weaker the farther their containers
    are in the tree; of the next two blocks of one container with more in between."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        holder = b.node.parent or b.node
        if i:
            before = blocks[i - 1].node
            out.append((i - 1, i, smooth / (1 + _steps(before.parent or before, holder))))
        j = last.get(holder)
        if j is not None and j != i - 1:
            out.append((j, i, smooth / 2))
        last[holder] = i
    return out


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that maximise the gains of those true less the weights of edges between unlike ones."""
    n, gain = len(gain), list(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:  # a terminal that outweighs all edges decides
        i = queue.popleft()
        if label[i] is None and abs(gain[i]) >= sum(near[i].values()):
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                gain[j] += w if label[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _max_flow(rest, gain, near), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _max_flow(rest: list[int], gain: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Source side of the minimum cut: levels from the source, then blocking flows along them."""
    at = {i: k for k, i in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    left: list[dict[int, float]] = [{} for _ in range(len(rest) + 2)]
    for i in rest:
        k = at[i]
        for j, w in near[i].items():
            left[k][at[j]] = w
        left[source][k], left[k][source] = max(gain[i], 0.0), 0.0
        left[k][sink], left[sink][k] = max(-gain[i], 0.0), 0.0
    tiny = 1e-12
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in left[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return [k in level for k in range(len(rest))]
        ways = {u: [v for v in left[u] if level.get(v) == level[u] + 1] for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(left[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    left[a][b] -= flow
                    left[b][a] += flow
                path = path[: next(k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if left[a][b] <= tiny) + 1]
                continue
            while ways[u] and left[u][ways[u][-1]] <= tiny:
                ways[u].pop()
            if ways[u]:
                path.append(ways[u][-1])
            else:
                path.pop()
                if path:
                    ways[path[-1]].pop()


def kept(blocks: list[Block], model: Model) -> list[bool]:
    """Which blocks the minimum cut leaves on the content's side."""
    return min_cut((features(blocks) @ model.weights).tolist(), edges_of(blocks, model.smooth))


def main_text(page: str, model: Model | None = None) -> str:
    """The content blocks of a page, joined by an empty line."""
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, k in zip(blocks, kept(blocks, model or trained()), strict=True) if k)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each whole page."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())  # a weight for each feature

    def per_batch(batch):
        found = [main_text(x, shared.value) for x in texts(batch, "html")]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": found, "n_chars": [len(x) for x in found]}

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return mapped(rows, per_batch, "page_id long, url string, text string, n_chars long")

"""MinHash near-deduplication with bottom-k sketches from one hash function.

1. A document's set is its distinct word shingles, hashed to 64 bits; its sketch
   is the k smallest. Documents with one word sequence have one set, so they are
   represented by the smallest id and need no pairs.
2. Inverted lists of retained values. Two sets with similarity s share a binomial
   number (k, s) of the k smallest values of their union, and all of those are in
   both sketches. With k = 48 and s = 0.75 they share fewer than 22 with probability
   7e-6. A document therefore enters only the lists of its (shared values - 22 + 1)
   rarest values: by the prefix-filter argument two sketches that share 22 still
   meet, and texts that quote the same passages, but for less than about half of
   themselves, mostly don't.
3. Stars: each list's document whose values are the most common in all lists is
   tried against the rest. Candidates are linear in the lists, whatever a list's
   length. They pass if the sizes allow the similarity and the union sketch has 22
   of 48 values in both (the same probability); then the exact Jaccard of the whole
   sets decides.
4. Components of the confirmed links. Where a list still holds several components,
   links between them may be left. The documents of such lists are listed anew by
   items of their whole sets: two sets that link share one of the rarest items of
   each, as many as their sizes leave to differ (plus one), fewer of the smaller set
   than of the larger one, and of these only items that both have count. Edited copies
   too far from each other to link thus have few lists in common or none, even where
   thousands share an original. Each set also has
   a parity bitmap: bit b is set if an odd number of its items hash to b. An item that
   only one of two sets has flips one bit of their difference, so the bits that differ
   are a lower bound of the items that differ, and a link allows (1 - s) / (1 + s) of
   both sizes' sum of these. Every pair of different components in one such list that
   sizes and bitmaps allow is tried as in 3, so no link between components is lost.

Nodes are the distinct word sequences, not the ids: rows that share an id but not the
text are linked each by its own text, and every row gets the answer for its text.

The only loss is in step 2 and in the union-sketch check: at most 7e-6 a link at the
similarity itself, less above it; ``k`` and ``shared`` set it.

Cases: null or wordless text has an empty set and links with nothing, being its
own component. Fewer words than a shingle: the whole sequence is the one shingle.
Rows that repeat id and text get the same answer. A null id is never linked and
has a null component. An empty table gives an empty result. Extra columns are
carried only by ``deduplicated``, which keeps every row of an id that stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.batches import mapped, texts
from plumbline.llm.components import components
from plumbline.storage import Scratch, written

WORDS, SIMILARITY = 5, 75
SKETCH, SHARED = 48, 22
#: 64-bit words of a parity bitmap.
MARKS = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8."""
    return text.encode().lower().split()


def shingle_hashes(words: list[bytes], width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = (out ^ (out >> np.uint64(29))) * _BASE + h[j : j + n]
    out = (out ^ (out >> np.uint64(32))) * _BASE
    return np.unique((out ^ (out >> np.uint64(29))).view(np.int64))


def _listed(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64)))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, k: int = SKETCH) -> DataFrame:
    """(id, n, digest, sketch): set size, 128-bit hash of the word sequence, k smallest hashes."""

    def per_batch(batch):
        digests, sizes, kept = [], [], []
        for text in texts(batch):
            words = words_of(text)
            values = shingle_hashes(words, width)
            digests.append(hashlib.md5(b" ".join(words)).digest() if words else None)
            sizes.append(len(values))
            kept.append(values[:k])
        return {"id": batch.column("id"), "n": sizes, "digest": digests, "sketch": _listed(kept)}

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return mapped(rows, per_batch, "id long, n long, digest binary, sketch array<long>")


def parity(items: np.ndarray, words: int = MARKS) -> np.ndarray:
    """Bitmap of ``words`` longs; each item flips the bit that its hash names."""
    at = (items.view(np.uint64) % np.uint64(64 * words)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=64 * words).astype(np.uint8) & 1).view(np.int64)


def shingle_sets(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """(digest, items, marks): whole sets of the column text, the digest of each word sequence and the set's parity bitmap."""

    def per_batch(batch):
        words = [words_of(t) for t in texts(batch)]
        found = [shingle_hashes(w, width) for w in words]
        return {"digest": [hashlib.md5(b" ".join(w)).digest() for w in words], "items": _listed(found), "marks": _listed([parity(x) for x in found])}

    return mapped(docs.select("text"), per_batch, "digest binary, items array<long>, marks array<long>")


def _marks_fit(similarity: int) -> str:
    """Whether bitmaps ``marks`` and ``marks2`` of sets of n and n2 items differ by few enough bits for a link."""
    bits = " + ".join(f"bit_count(marks[{i}] ^ marks2[{i}])" for i in range(MARKS))
    return f"{100 + similarity} * ({bits}) <= {100 - similarity} * (n + n2)"


def _sizes_fit(a: str, b: str, similarity: int) -> str:
    return f"100 * least({a}, {b}) >= {similarity} * greatest({a}, {b})"


def links(pairs: DataFrame, sets: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Of the pairs (a, b), those whose whole sets are similar enough."""
    items = sets.select("node", "items")
    found = pairs.join(items.toDF("b", "of_b"), "b").join(items.toDF("a", "of_a"), "a")
    found = found.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("both"), (F.size("of_a") + F.size("of_b")).alias("sum"))
    return found.filter(f"100L * both >= {similarity}L * (sum - both)").select("a", "b")


def _prefixes(sets: DataFrame, among: DataFrame, similarity: int, keep: Scratch) -> DataFrame:
    """(v, node, n, m, at, small): of each set of ``among``, the rarest items by which it must meet any set it links with,
    each the ``at``-th rarest of the ``m`` that another set has too.

    A link shares at least ``similarity`` percent of the larger set, and of the smaller one
    2 s / (100 + s) of it, as the other is no smaller. So it shares one of the rarest
    n - that + 1 items of each: more as the larger set, and as the smaller one those that are
    ``small``. Items that no other set has come first among these and meet nothing.
    """
    items = lambda some: sets.join(some, "node", "left_semi").select("node", F.size("items").alias("n"), F.explode("items").alias("v"))
    everything = items(among)
    shared = keep.written(everything.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "shared-items")
    held = everything.join(shared.select("v"), "v", "left_semi").groupBy("node", "n").agg(F.count("*").alias("m"))
    reach = {"reach": f"m - ceil(n * {similarity} / 100) + 1", "reach_small": f"m - ceil(n * {2 * similarity} / {100 + similarity}) + 1"}
    able = keep.written(held.withColumns({k: F.expr(x) for k, x in reach.items()}).filter("reach > 0").select("node", "m", *reach), "able")
    ranked = items(able.select("node")).join(shared, "v").withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("df", "v")))
    return keep.written(ranked.join(able, "node").filter("at <= reach").select("v", "node", "n", "m", "at", (F.col("at") <= F.col("reach_small")).alias("small")), "prefixes")


def _met(short: DataFrame, similarity: int, keep: Scratch) -> DataFrame:
    """(node, n, marks, node2, n2, marks2): pairs of sets of different components that meet in a list of
    ``short`` (v, node, n, m, at, small, comp, marks), the first as the smaller one.

    Only small items bring a set to the lists that larger ones wait in, so sets too far from
    each other to link, however many items all of them share, mostly meet in none. A pair that
    links has enough items left behind the first one that both have; in lists where it hasn't
    it isn't made. Nor are pairs inside a list's largest component.
    """
    sizes = short.groupBy("v", "comp").agg(F.count("*").alias("m"), F.max("small").alias("any"))
    mixed = sizes.groupBy("v").agg(F.max(F.struct("m", "comp")).alias("big"), F.count("*").alias("comps"), F.max("any").alias("any")).filter("comps > 1 and any")
    ours = keep.written(short.join(mixed.select("v", F.col("big.comp").alias("big")), "v"), "ours")
    waiting = ours.select("v", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("comp").alias("comp2"), F.col("marks").alias("marks2"), (F.col("m") - F.col("at")).alias("behind2"), (F.col("comp") == F.col("big")).alias("in_big"))
    brought = ours.filter("small")
    pairs = brought.filter("comp <> big").join(waiting, "v").unionByName(brought.filter("comp = big").join(waiting.filter("not in_big"), "v"))
    return pairs.filter("comp <> comp2 and (n < n2 or n = n2 and node < node2)").filter(f"{100 + similarity} * (1 + least(m - at, behind2)) >= {similarity} * (n + n2)")


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, similarity: int = SIMILARITY, k: int = SKETCH, shared: int = SHARED
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``."""
    keep = Scratch(docs.sparkSession)
    all_rows = written(sketches(docs, id_col, text_col, width, k), "sketches")
    real = all_rows.filter("n > 0 and id is not null")
    first = real.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # numbered where they are written, so a number is the same whoever reads it
    reps = keep.written(first.withColumn("node", F.monotonically_increasing_id()), "representatives")

    postings = reps.select("node", "n", F.explode("sketch").alias("v"))
    lengths = keep.written(postings.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "list-lengths")
    of_node = Window.partitionBy("node", "n")
    need = F.least(F.lit(shared), F.greatest(F.lit(1), F.ceil(F.col("n") * shared / k)))
    ranked = postings.join(lengths, "v").select(
        "v", "node", "n", F.row_number().over(of_node.orderBy("df", "v")).alias("at"), F.count("*").over(of_node).alias("m"), F.sum("df").over(of_node).alias("fame")
    )
    lists = keep.written(ranked.filter(F.col("at") <= F.col("m") - need + 1).select("v", "node", "n", "fame"), "lists")

    def tried(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs (a, b) that pass the union-sketch estimate and the exact check."""
        pairs = keep.written(pairs.distinct(), "pairs")
        of = reps.select("node", "sketch")
        est = pairs.join(of.toDF("b", "sb"), "b").join(of.toDF("a", "sa"), "a")
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
        est = est.withColumn("u", union).filter(F.size(F.array_intersect(F.array_intersect("sa", "sb"), "u")) >= F.lit(shared / k) * F.size("u"))
        return links(keep.written(est.select("a", "b"), "candidates"), sets, similarity)

    most = F.max(F.struct("fame", (-F.col("node")).alias("order"), "node", "n"))
    centres = keep.written(lists.groupBy("v").agg(most.alias("c"), F.count("*").alias("m")).filter("m > 1").select("v", "c"), "centres")
    stars = lists.join(centres, "v").filter("node <> c.node").filter(_sizes_fit("n", "c.n", similarity)).select(F.col("c.node").alias("a"), F.col("node").alias("b"))
    meeting = lists.join(centres.select("v"), "v", "left_semi").select("node").distinct()
    meeting = keep.written(reps.join(meeting, "node", "left_semi").select("node", "id", "digest"), "meeting")
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(meeting.select("id"), "id", "left_semi")
    sets = keep.written(shingle_sets(wanted, width).join(meeting.select("digest", "node"), "digest").drop("digest").dropDuplicates(["node"]), "sets")
    found = keep.written(tried(stars, sets), "links")
    comp = components(found, keep)

    placed = keep.written(lists.join(comp.toDF("node", "comp"), "node", "left").select("v", "node", F.coalesce("comp", "node").alias("comp")), "placed")
    mixed = placed.groupBy("v").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("v")
    inside = keep.written(placed.join(mixed, "v", "left_semi").select("node", "comp").distinct(), "inside")
    if not inside.isEmpty():
        short = _prefixes(sets, inside.select("node"), similarity, keep).join(inside, "node")
        short = keep.written(short.join(sets.select("node", "marks"), "node"), "short")
        more = _met(short, similarity, keep).filter(_sizes_fit("n", "n2", similarity)).filter(_marks_fit(similarity))
        more = keep.written(tried(more.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")), sets), "more-links")
        if not more.isEmpty():
            comp = components(found.union(more), keep)

    linked = reps.select("node", "digest", "id").join(comp.toDF("node", "comp"), "node")
    smallest = linked.groupBy("comp").agg(F.min("id").alias("component"))
    named = reps.select("digest", "node", "id").join(comp.toDF("node", "comp"), "node", "left").join(smallest, "comp", "left")
    named = written(named.select("digest", F.coalesce("component", "id").alias("component")), "named")
    keep.free()
    out = all_rows.select("id", "n", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(named, "digest", "left")
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, all columns."""
    stay = written(near_classes(docs, id_col, text_col).filter("kept").select("doc_id").distinct(), "near-kept")
    return docs.join(stay, docs[id_col].eqNullSafe(stay["doc_id"]), "left_semi")

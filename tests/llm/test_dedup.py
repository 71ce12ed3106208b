"""Exact and near deduplication against brute force."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from plumbline.llm import components, exact_dedup, near_dedup

SCHEMA = "doc_id long, text string, id string, n string, h string"


def table(spark, rows):
    """Rows (doc_id, text) beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One  two"), (6, "one two"), (6, "one two"), (7, "é" * 5000), (None, "lonely text"), (None, None)]


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0d]", "", t or "") for _, t in rows]
    out = []
    for n in norm:
        group = [r for r, m in zip(rows, norm) if m == n]
        best = min(group, key=lambda r: (-len(r[1] or ""), r[0] is not None, r[0] or 0))
        out.append((best[0], len(group)))
    return out


@pytest.mark.parametrize("collide", [False, True])
def test_exact_classes(spark, collide):
    hash_of = (lambda norm: F.lit("same")) if collide else exact_dedup.content_hash
    got = exact_dedup.classes(table(spark, ODD), hash_of=hash_of).collect()
    want = sorted(((i, *w) for (i, _), w in zip(ODD, brute_exact(ODD))), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == want


def test_exact_keeps_one_row_of_each_group(spark):
    got = exact_dedup.deduplicated(table(spark, ODD))
    assert got.columns == ["doc_id", "text", "id", "n", "h"]
    texts = [re.sub(r"\s", "", r.text or "") for r in got.collect()]
    assert len(texts) == len(set(texts)) == 5


def test_exact_of_nothing(spark):
    assert exact_dedup.classes(table(spark, [])).count() == 0
    assert exact_dedup.deduplicated(table(spark, [])).count() == 0


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_near(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_classes_by_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=40)
    rows, i = [], 0
    for group in range(6):
        base = rng.choices(vocabulary, k=120) + passage
        for _ in range(25):
            rows.append((i, edited(rng, base, rng.randrange(9))))
            i += 1
    # a chain: neighbours are alike, its ends are not
    chain = rng.choices(vocabulary, k=200)
    for step in range(8):
        rows.append((i, " ".join(chain[step * 12 : step * 12 + 100])))
        i += 1
    rows += [(i + k, t) for k, t in enumerate([None, "", "  ", "Just four short words", "just FOUR short words", "just four short word"])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_classes(table(spark, rows)).collect()}
    assert got == brute_near(rows)


def test_near_classes_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_classes(docs).collect()}
    assert got == brute_near(rows)


def test_near_classes_of_a_thousand_documents(spark):
    """The exact join over all of sf0.01, pairs found by their shared shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.select("doc_id", "text").collect()}
    lists = {}
    for i, found in sets.items():
        for x in found:
            lists.setdefault(x, []).append(i)
    both = Counter(pair for ids in lists.values() for pair in combinations(sorted(ids), 2))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_classes(docs).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}


def test_pairs_of_sets_just_too_far_apart_do_not_grow_with_their_square(spark, monkeypatch):
    """n documents that share 96 shingles and have 20 of their own: those that are compared grow no faster than n."""
    counted = []
    real = near_dedup._met

    def counting(*given):
        pairs = real(*given)
        counted.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_dedup, "_met", counting)
    base = " ".join(f"w{k}" for k in range(100))
    for n in (250, 1000):
        rows = [(i, base + " " + " ".join(f"own{i}x{k}" for k in range(20))) for i in range(n)]
        rows += [(n + i, rows[i][1] + " end") for i in range(5)]  # some that do link
        got = {r.doc_id: r.component_id for r in near_dedup.near_classes(table(spark, rows)).collect()}
        assert got == {i: i if i < n else i - n for i, _ in rows}
    assert counted[1] <= 6 * max(counted[0], 1) and counted[1] < 5000


def test_near_odd_rows_and_empty_table(spark):
    got = near_dedup.near_classes(table(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.doc_id in (4, 5, 6)} == {4}
    assert near_dedup.near_classes(table(spark, [])).count() == 0
    assert near_dedup.deduplicated(table(spark, [])).columns == ["doc_id", "text", "id", "n", "h"]


def test_rows_that_share_an_id_are_linked_by_their_own_text(spark):
    rng = random.Random(9)
    a, b = ([f"{x}{i}" for i in rng.choices(range(300), k=120)] for x in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a) + " more"), (3, " ".join(b) + " more"), (4, "something else")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_classes(table(spark, rows)).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_half_alike_copies_make_no_links_and_lose_none(spark):
    """Many copies of one original, most too far from each other to link, some close in pairs."""
    rng = random.Random(10)
    base = [f"w{i}" for i in rng.choices(range(2000), k=150)]
    rows = []
    for i in range(120):
        text = edited(rng, base, 30)
        rows.append((2 * i, text))
        rows.append((2 * i + 1, edited(rng, text.split(), 3) if i % 4 == 0 else edited(rng, base, 30)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_classes(table(spark, rows)).collect()}
    assert got == brute_near(rows) and len({c for _, c in got.values()}) > 100


def test_parity_bitmap_never_exceeds_the_difference():
    rng = random.Random(1)
    for size in (3, 50, 5000):
        a = {rng.getrandbits(63) for _ in range(size)}
        b = set(rng.sample(sorted(a), size // 2)) | {rng.getrandbits(63) for _ in range(size // 3)}
        import numpy as np

        x, y = (near_dedup.parity(np.array(sorted(s), np.int64)).view(np.uint64) for s in (a, b))
        assert sum(int(v).bit_count() for v in x ^ y) <= len(a ^ b)


def test_components_of_a_long_path(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(100, 200), (200, 300)], "a long, b long"))
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}

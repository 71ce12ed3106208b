"""Vector codes, license templates and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from plumbline.llm import license_texts, licenses, periodic_runs, queries, vector_codes

# ---- vector codes ---------------------------------------------------------------------------


def codes_by_definition(rows, parts, entries, rounds):
    """{row: (code, error)} and the codebooks, in Python's integers."""
    vectors = [(i is None, i or 0, [math.floor(256 * x) for x in v], v) for i, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda k: (vectors[k][0], vectors[k][1], vectors[k][3]))
    width = len(rows[0][1]) // parts
    cut = lambda k, p: vectors[k][2][p * width : (p + 1) * width]
    books = [[cut(k, p) for k in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assigned():
        return [[min((far(cut(k, p), e), j) for j, e in enumerate(books[p])) for p in range(parts)] for k in range(len(rows))]

    for _ in range(rounds):
        near = assigned()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [cut(k, p) for k in range(len(rows)) if near[k][p][1] == j]
                if mine:
                    books[p][j] = [sum(x) // len(mine) for x in zip(*mine)]
    return [("".join(f"{j:02x}" for _, j in n), sum(d for d, _ in n)) for n in assigned()], books


@pytest.mark.parametrize("n", [300, 20, 1])
def test_codes_by_definition(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([k, k // 2]), [rng.choice([0.0, rng.gauss(0, 0.3), -0.25]) for _ in range(32)], rng.choice([None, 1, 2, 2, 2])) for k in range(n)]
    rows[-1] = (None, rows[-1][1], 1)
    extra = [(9, None, 1), (10, [0.0] * 31 + [None], 1), (11, [math.nan] * 32, 1), (12, [0.0] * 31 + [math.inf], 1), (13, [0.5] * 16, 1), (14, [], 1), (15, [4e6] * 32, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + extra], "vec_id long, embedding array<double>, label int, code int, vector int").repartition(5)
    got = vector_codes.compressed(df, parts=16, entries=64, rounds=2).collect()
    want, books = codes_by_definition(rows, 16, 64, 2)
    totals = {}
    for (_, _, label), (_, error) in zip(rows, want):
        totals[label] = totals.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert sorted(map(str, got)) == sorted(
        str(type(got[0])(vec_id=i, code=c, error=e, label_error=totals[label], codebooks_sha256=digest)) for (i, _, label), (c, e) in zip(rows, want)
    )


def test_bounds_hold_and_exclude():
    rng = np.random.default_rng(1)
    entries, queries_ = rng.integers(-300, 300, (64, 4)), rng.integers(-400, 400, (500, 4))
    entries[5] = entries[3]
    book = vector_codes.VaFile(entries)
    least, most = book.bounds(queries_)
    exact = ((entries[:, None] - queries_[None]) ** 2).sum(axis=2)
    assert (least <= exact).all() and (exact <= most).all()
    assert (least <= most.min(axis=0)).mean() < 0.3  # most entries are left out by the cells alone
    at, off = book.nearest(queries_)
    assert (at == exact.argmin(axis=0)).all() and (off == exact.min(axis=0)).all()


def test_no_vectors_and_decoding(spark):
    df = spark.createDataFrame([(1, None, 1), (2, [], 1)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compressed(df).count() == 0 and vector_codes.compressed(df.limit(0)).count() == 0
    vectors = spark.createDataFrame([(k, [k / 4, 1.0, -k / 8, 0.0]) for k in range(50)], "vec_id long, embedding array<float>")
    books = vector_codes.learnt(vectors, parts=2, entries=64, rounds=0)
    for r in vector_codes.coded(vectors, books, label_col=None).collect():
        assert r.error == 0 and books.decoded(r.code).tolist() == [r.vec_id / 4, 1.0, -r.vec_id / 8, 0.0]


# ---- licenses -------------------------------------------------------------------------------


def test_automata_accept_what_regular_expressions_do():
    rng = random.Random(5)
    templates = ["a [[b]] c", "a <<x:3>> b", "{{a|b}} [[c [[d]] <<y:1>>]] a", "a [[b]] [[b c]] <<z:2>> [[d]]", "b <<w:0>> c"]
    for template in templates:
        automaton, pattern = licenses.compiled(template), re.compile(licenses.as_regex(template) + "(?= |$)")
        for _ in range(3000):
            words = rng.choices("abcde", k=rng.randrange(1, 9))
            line = " " + " ".join(words)
            for at in range(len(words)):
                ends = [end for end in range(at, len(words) + 1) if re.fullmatch(pattern.pattern, "".join(" " + w for w in words[at:end]))]
                assert automaton.end([w.encode() for w in words], at) == (max(ends) if ends else None), (template, line, at)
    for wrong in ("[[a", "a]]", "<<x:2>> a", "[[a]] b [[", "[[a]]", ""):
        with pytest.raises(ValueError):
            licenses.compiled(wrong)


def test_whole_wordings_match_and_changed_ones_do_not(spark):
    mit = """Copyright (c) 2020 Somebody

    Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
    in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
    copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
    The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    rows = [
        (1, mit), (2, mit.replace("without fee", "").replace("free of charge", "for a charge")), (3, gnu), (4, "Licensed under the Apache License, Version 2.0."), (5, "the Apache License"),
        (6, "This work is licensed under the GNU General Public License, version 3."), (7, "Released under the MIT License. MIT LICENSE"), (8, None), (9, ""), (10, "Licensed under CC BY-NC 4.0."), (11, "mit" + " x" * 200_000 + " MIT-license"), (None, "É Licence"),
    ]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, labels string, words int")
    got = {r.doc_id: r for r in licenses.scanned(df).collect()}
    labels = {k: r.labels for k, r in got.items()}
    assert labels == {1: "mit-text", 2: "", 3: "gpl,gpl-3.0-text", 4: "apache,apache-2.0-grant", 5: "apache", 6: "gpl,gpl-3.0-grant", 7: "mit,mit-grant", 8: "", 9: "", 10: "cc-by-nc-4.0-grant", 11: "mit", None: ""}
    assert (got[7].n_base, got[7].first_word, got[7].last_word, got[7].base_labels) == (2, 3, 5, "mit")
    assert (got[8].n_words, got[8].n_base, got[8].first_word, got[8].score) == (0, 0, None, 0.0) and (got[5].score, got[1].score) == (0.5, 1.0)
    assert (got[11].n_words, got[11].first_word) == (200_003, 200_001) and got[None].n_words == 2
    assert [(m.label, m.start, m.end) for m in got[10].matches] == [("cc-by-nc-4.0-grant", 0, 7)]
    assert licenses.scanned(df.limit(0)).count() == 0


def test_every_template_matches_its_own_wording():
    for label, template in license_texts.TEMPLATES:
        plain = re.sub(r"\{\{([^{}|]*)[^{}]*\}\}", r"\1", re.sub(r"<<[^<>]*>>", " thing ", re.sub(r"\[\[|\]\]", " ", template)))
        words = licenses.words_of(plain)
        assert licenses.compiled(template).end(words, 0) == len(words), label


# ---- runs -----------------------------------------------------------------------------------


def runs_by_definition(words, least=6, periods=4):
    found = set()
    n = len(words)
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, periods * q):
                run = words[i : j + q]
                if not any(run[p:] == run[:-p] for p in range(1, q)):
                    found.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found)


def row_by_definition(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_definition(words)
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


@pytest.mark.parametrize("least,periods", [(6, 4), (2, 2), (4, 3)])
def test_runs_by_definition(least, periods):
    rng = random.Random(least)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 8)):
            words = rng.choices("abc"[: rng.randrange(1, 4)], k=rng.randrange(30))
            for _ in range(rng.randrange(3)):
                words += rng.choices("ab", k=rng.randrange(1, 5)) * rng.randrange(1, 8)
            texts.append(words)
        got = periodic_runs.found_in([" ".join(t).encode() for t in texts], None, least, periods)
        assert [f.runs for f in got] == [runs_by_definition(t, least, periods) for t in texts]


def test_query_by_definition(spark):
    got = sorted(map(tuple, queries.op13_lyndon_runs(spark, "/root/testdata/sf0.001").collect()))
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(row_by_definition(*r) for r in rows) and any(r[1] for r in got)


def test_odd_texts(spark):
    rng = random.Random(8)
    edited = next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 50), (4, "a " * 50), (None, "b " * 9), (edited, None), (edited, "one two three"), (6, "x\x1cy z " * 7), (7, "é ü " * 20 + "a b c " * 5)]
    rows += [(8, " ".join(rng.choices("ab", k=3000))), (9, " ".join(str(k) for k in range(100_000)) + " z" * 40)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, n_runs int, start string")
    got = sorted(map(str, map(tuple, periodic_runs.periodic(df).drop("runs").collect())))
    want = [row_by_definition(*r) for r in rows[:-1]]
    last = " ".join(str(k) for k in range(100_000)) + " z"
    want.append((9, 1, 100_000, 40, 1, 40_000, hashlib.sha256(b"100000,40,1\n").hexdigest(), hashlib.sha256(last.encode()).hexdigest()))
    assert got == sorted(map(str, want))
    assert periodic_runs.periodic(df.limit(0)).count() == 0
    texts = {r.doc_id: r.text for r in periodic_runs.collapsed(df).collect()}
    assert texts[1] is None and texts[4] == "a" and texts[7] == "é ü a b c" and texts[3] == " \t\n"

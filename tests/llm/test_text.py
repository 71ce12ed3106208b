"""Winnowing, the random fields, personal data, main text, url rules and WARC against brute force."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from plumbline.llm import crf, language, maincontent, pii, pii_samples, queries, url_rules, warc, winnowing


def test_winnowing_by_definition():
    rng = random.Random(2)
    for n in (0, 1, 5, 15, 16, 17, 38, 39, 40, 400):
        text = "".join(rng.choice("ab é") for _ in range(n))
        hashes = winnowing.gram_hashes(winnowing.code_points(text)).tolist()
        assert len(hashes) == (max(1, n - winnowing.K + 1) if n else 0)
        windows = [range(i, i + winnowing.WINDOW) for i in range(len(hashes) - winnowing.WINDOW + 1)] or [range(len(hashes))] * bool(n)
        want = sorted({min(w, key=lambda i: (hashes[i], -i)) for w in windows})
        assert winnowing.winnowed(np.array(hashes, np.uint32)).tolist() == want


def test_shared_passage_shares_a_hash():
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(winnowing.K + winnowing.WINDOW - 1))
    a, b = (winnowing.fingerprint("".join(rng.choices("ijkl", k=n)) + passage + "z" * n)[1] for n in (50, 77))
    assert set(a.tolist()) & set(b.tolist())


def test_edited_texts_and_likeness(spark):
    rows = [(1, "abc"), (2, None), (5, "x" * 300), (9, "the last of them all, é"), (9, "another nine"), (None, "no id")]
    got = winnowing.edited_likeness(spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, extra string"))
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest()))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = (set(winnowing.fingerprint(x)[1].tolist()) for x in (t, new, after))
        like = lambda p, q: len(p & q) / len(p | q) if p | q else 1.0
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), like(a, b), like(a, c)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next)) for r in got.collect())
    assert winnowing.edited_likeness(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_small_buckets_and_clashing_names(spark, monkeypatch):
    """As many buckets as shuffle partitions, names that the operator uses itself, and a very long text."""
    monkeypatch.setattr(winnowing, "PART_BYTES", 200)
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("abc d", k=rng.randrange(60))), 1, 2, 3, 4) for i in range(500)]
    rows.append((77_777, "long " * 300_000, 1, 2, 3, 4))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        got = winnowing.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string, part int, last int, extra int, top int")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(rows, reverse=True)
    want = {i: t[: len(t) - len(t) // 2] + after[: len(t) // 2] for (i, t, *_), (_, after, *_) in zip(order, order[1:] + order[:1])}
    assert {r.doc_id: r.edited_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()} and len(got) == len(rows)


@pytest.mark.parametrize("same_text", [False, True])
def test_an_id_that_half_of_the_rows_share(spark, monkeypatch, same_text):
    """Its rows are spread over parts of about one size, none of them is copied, and every row has its successor."""
    monkeypatch.setattr(winnowing, "PART_BYTES", 4000)
    rng = random.Random(9)
    rows = [(77 if k % 2 else k, "the same text again" if same_text and k % 2 else "".join(rng.choices("abcd ", k=30)) + str(k)) for k in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        placed = winnowing.with_successor(df)
        sizes = Counter(r.part for r in placed.select("part").collect())
        got = winnowing.edited_likeness(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(sizes.values()) <= len(rows) + 32 and max(sizes.values()) < 4 * len(rows) / len(sizes)
    order = sorted(rows, key=lambda r: (-r[0], xxhash.xxh64(r[1].encode(), seed=42).intdigest()))
    want = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        want[i, hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want


def test_language_sample_is_bounded(spark, monkeypatch):
    """An id and text that repeat 50,000 times are one document of the sample; so are its bytes bounded."""
    taken = {}
    monkeypatch.setattr(language, "train", lambda samples: taken.update(samples))
    rows = spark.range(50_000).selectExpr("cast(1 as long) doc_id", "'the same words' text", "'en' lang").unionByName(spark.range(2000).selectExpr("id doc_id", "concat('words ', id) text", "'de' lang"))
    language.fitted(rows)
    assert taken["en"] == ["the same words"] and len(taken["de"]) == language.PER_LABEL
    taken.clear()
    monkeypatch.setattr(language, "ALL_BYTES", 100)
    language.fitted(rows)
    assert 0 < sum(len(t) for ts in taken.values() for t in ts) <= 100


def test_language_query_columns_by_definition(spark):
    """Rows, held_out and the values that a prediction may have, from the contract alone."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in docs.select("doc_id", "text", "lang").collect()}
    held = {i for i in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    learnt = {r.lang for i, r in rows.items() if i not in held and r.lang}
    got = queries.op3_crf_language(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        letters = any(c.isalpha() for c in rows[r.doc_id].text or "")
        assert r.held_out == (r.doc_id in held) and 0 <= r.score <= 1
        assert r.lang_pred in learnt if letters else (r.lang_pred, r.score) == ("und", 0.0)
    other = docs.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'xx' else lang end lang", "'s' source")
    again = language.predicted(other, language.fitted(other)).collect()  # neither the held-out languages nor sources are inputs
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_forward_backward_and_viterbi_by_enumeration():
    rng = np.random.default_rng(5)
    lengths, labels = np.array([1, 4, 6, 2]), 3
    score, t = rng.normal(size=(lengths.sum(), labels)), rng.normal(size=(labels, labels))
    first = np.zeros(len(score), bool)
    first[np.cumsum(lengths) - lengths] = True
    p, best = crf.posteriors(score, t, first, block=4), crf.viterbi(score, t, lengths)
    at = 0
    for n in lengths:
        paths = list(itertools.product(range(labels), repeat=int(n)))
        value = np.array([sum(score[at + i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])) for path in paths])
        weight = np.exp(value) / np.exp(value).sum()
        for i in range(n):
            for y in range(labels):
                assert abs(p[at + i, y] - sum(w for w, path in zip(weight, paths) if path[i] == y)) < 1e-9
        assert tuple(best[at : at + n]) == paths[int(value.argmax())]
        at += n


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language.predicted(docs, language.fitted(docs)).collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    assert len(got) == len(rows)
    tried = [(got[r.doc_id].lang_pred, r.lang) for r in rows if got[r.doc_id].held_out and r.lang and len(re.findall(r"[^\W\d_]+", r.text or "")) >= 5]
    assert len(tried) > 100
    assert sum(a == b for a, b in tried) / len(tried) >= 0.95


def test_language_odd_rows(spark):
    none = spark.createDataFrame([(1, None, "en"), (2, "12 !?", "en"), (3, "", None), (None, "words here", None)], "doc_id long, text string, lang string")
    got = language.predicted(none, language.fitted(none)).collect()
    assert {(r.lang_pred, r.score) for r in got if r.doc_id} == {("und", 0.0)}
    assert language.predicted(none.limit(0), language.train({})).count() == 0


def spec(text):
    """The fixed patterns by the standard module alone."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(kinds) for m in re.finditer(p, text) if good(m[0]))


def test_pattern_spans_by_specification(spark):
    rng = random.Random(6)
    parts = ["a", "b.c", "@", "@d.e", ".", "-", " ", "1", "10", "255", "256", "4111 1111 1111 1111", "+1 (555) 555-0100", "+", "x@y.z", "\n", "1.2.3.4", "é", "%"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(4000)]
    texts += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in texts:
        assert pii.pattern_spans(text) == spec(text), text


def test_secrets_and_redaction(spark):
    text = "mail me@x.org\nthe password=8c1fa0b7e2d94412aa was set, and the key is lost."
    (base, spans), = pii.all_spans([text])
    assert [k for _, k, _ in base] == [0]
    assert [text[s:e] for s, k, e in spans if k == 4] == ["8c1fa0b7e2d94412aa"]
    docs = spark.createDataFrame([(1, text, 9), (2, None, 1), (3, "", 1), (None, "clean", 1)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in pii.redacted(docs, length_col="n_chars").collect()}
    assert got[1].text == "mail [EMAIL]\nthe password=[SECRET] was set, and the key is lost." and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "" and got[None].text == "clean"
    assert pii.found_in(docs.limit(0)).count() == 0


def test_a_secret_over_a_card_number_is_redacted_whole(spark):
    for token in ("ab4111111111111111cd", "8c1fa4111111111111111e", "4111111111111111ab9c"):
        text = f"the password={token} was set"
        (base, spans), = pii.all_spans([text])
        assert [k for _, k, _ in base] == [2]
        assert [text[s:e] for s, k, e in spans if k == 4] == [token]
        row = pii.redacted(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        assert row.text in ("the password=[SECRET] was set", "the password=[CARD] was set")


def test_undecoded_lines_have_no_span(spark):
    """Lines without a cue or a street word, which are passed over, have a best path without labels."""
    model = pii.trained()
    lines = {line for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() for line in (r.text or "").split("\n")}
    for line in lines:
        if pii.TRIGGERS.isdisjoint(pii._words(line.lower())):
            score = np.array([model.score(t) for t, _, _ in pii.line_tokens(line)])
            assert not crf.viterbi(score, model.transitions, np.array([len(score)])).any()


def test_learnt_spans_on_held_out_lines():
    lines = pii_samples.labelled_lines(held_out=True)
    hit, said, true = Counter(), Counter(), Counter()
    for (line, want), (_, spans) in zip(lines, pii.all_spans([x for x, _ in lines])):
        got = {(s, pii.KINDS[k], e) for s, k, e in spans if k >= 4}
        for counts, some in ((said, got), (true, set(want)), (hit, got & set(want))):
            counts.update(kind for _, kind, _ in some)
    for kind in pii_samples.LEARNT:
        print(f"{kind}: precision {hit[kind] / said[kind]:.3f}, recall {hit[kind] / true[kind]:.3f} of {true[kind]}")
        assert hit[kind] >= 0.95 * said[kind] and hit[kind] >= 0.95 * true[kind] and true[kind] > 30


def test_columns_of_found_spans_by_specification(spark):
    """The digest columns against the patterns by the standard module, and what the CRF adds to them."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    odd = [(-1, None), (-2, ""), (-3, "My name is John Smith, SSN 123-45-6789, mail a@b.cd"), (-3, "My name is John Smith, SSN 123-45-6789, mail a@b.cd"), (None, "1.2.3.4"), (-4, "a@b.cd, " * 50_000)]
    docs = spark.createDataFrame([(i, t, "x", "y", 3) for i, t in rows + odd], "doc_id long, text string, spans string, base_sha256 string, n_email int")
    got = {}
    for r in pii.found_in(docs).collect():
        assert got.setdefault(r.doc_id, r) == r
    assert len(got) == len(rows) + len(odd) - 1
    for i, text in rows + odd:
        base, r = spec(text or ""), got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for _, k, _ in base) for kind in range(4))
        named = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(r.spans.split(",") if r.spans else []) and r.n_spans == (r.spans.count(",") + 1 if r.spans else 0)
        starts = [(int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])) for x in r.spans.split(",")] if r.spans else []
        assert starts == sorted(starts)
    assert [x.split(":")[0] for x in got[-3].spans.split(",")] == ["name", "national_id", "email"]


def test_min_cut_by_enumeration():
    rng = random.Random(7)
    for _ in range(150):
        n = rng.randrange(1, 9)
        gain = [rng.uniform(-1, 1) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 0.8)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        value = lambda label: sum(g for g, k in zip(gain, label) if k) - sum(w for i, j, w in edges if label[i] != label[j])
        got = maincontent.min_cut(gain, edges)
        assert value(got) >= max(map(value, itertools.product([False, True], repeat=n))) - 1e-9


def test_main_text(spark):
    page = "<nav><a>Home</a></nav><article><h1>A &amp; B</h1><p>One\n  two.<p>Three<br>four, and more of the story.</article><script>x<p>y</script><footer>&copy; us</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<div><p>cut off <b"), (None, "u", "<article><p>Text, with no id.")]
    got = {r.page_id: r for r in maincontent.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "A & B\n\nOne two.\n\nThree four, and more of the story."
    assert (got[2].text, got[3].text) == ("", "") and got[None].text == "Text, with no id."
    assert all(r.n_chars == len(r.text) for r in got.values())


URLS = ["http://a.NET/x", "https://Example.com/de/1?q", "https://example.com/en", "http://sub.example.net/en/a#b", "http://example.net/enx", "http://org/fr/", "http://o.org/fr", "nothing", None, "http://net", "x://notexample.com/de/", "http://[::1]/fr/", "http://com.example/de/"]


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fit = [r for r in queries.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_url_rules(spark):
    rows = [*enumerate(URLS), (None, URLS[0]), (3, URLS[3]), (3, URLS[3])]
    pages = spark.createDataFrame([(i, u, "k", "h", 1, 2) for i, u in rows], "page_id long, url string, key string, host string, kind int, part int")
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    want = sorted(str((i, *brute_rule(u))) for i, u in rows)
    got = url_rules.judged(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert url_rules.judged(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judged(pages, rules.limit(0)).collect()} == {"allow"}
    odd = spark.createDataFrame([("net", "/", "allow"), ("net", "/", "block"), (None, "/", "block"), ("net", None, "block"), ("a.net", "", "allow")], rules.schema)
    assert {r.page_id: (r.rule, r.verdict) for r in url_rules.judged(pages, odd).collect()}[0] == ("a.net", "allow")


def test_many_rules_over_many_ranges(spark, monkeypatch):
    """More ranges than hosts, a host with half of the rows, nested rules that begin in earlier ranges."""
    monkeypatch.setattr(url_rules, "RANGE_ROWS", 20)
    rng = random.Random(8)
    label = lambda: rng.choice("abcd")
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 4)))
    rules = {(host(), rng.choice([path(), "/"])): rng.choice(["allow", "block"]) for _ in range(400)}
    urls = [(i, f"http://{'b.a' if rng.random() < 0.5 else host()}{path()}") for i in range(600)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "25")
    try:
        got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judged(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame([(*k, v) for k, v in rules.items()], "host string, path string, verdict string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for i, url in urls:
        h, p = url.removeprefix("http://").split("/", 1)
        fit = [(h2, p2) for h2, p2 in rules if (h == h2 or h.endswith("." + h2)) and ("/" + p).startswith(p2)]
        best = max(fit, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), default=None)
        assert got[i] == ((best[0] + best[1], rules[best]) if best else (None, "allow")), url


def test_archive_round_trip_and_lookup(spark):
    rows = [(3, "http://a.com/1", "<p>é"), (1, "http://b.a.com/", "<p>é"), (2, None, None), (4, "http://a.com/1", ""), (5, "http://c.org/x y", "z" * 100_000), (None, "http://n", "z")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, file string, sha string")
    archive = warc.written_archive(pages, block=2)
    captures = warc.captures_of(archive)
    got = {r.page_id: r for r in warc.records(archive, captures, with_payload=True).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert (got[1].record_type, got[3].record_type, got[3].refers_to, got[4].refers_to) == ("response", "revisit", 1, 2)
    assert bytes(got[5].payload) == b"z" * 100_000
    asked = spark.createDataFrame([("http://a.com/1",), ("http://absent/",), ("http://a.com/1",)], "url string")
    assert sorted(r.page_id for r in warc.captures_at(archive, asked).collect()) == [3, 4]
    everything = warc.captures_at(archive, pages).collect()
    assert sorted(map(str, everything)) == sorted(map(str, captures.collect())) and len(everything) == len(rows)
    empty = warc.written_archive(pages.limit(0))
    assert warc.captures_of(empty).count() == warc.captures_at(empty, pages).count() == 0
    large = warc.written_archive(pages, min_bytes=3)
    kinds = {r.page_id: r.record_type for r in warc.records(large, warc.captures_of(large)).collect()}
    assert kinds[4] == kinds[2] == "response" and kinds[3] == "revisit"


def test_lookup_over_many_ranges_with_a_hot_url(spark, monkeypatch):
    """A url with half of the captures fills many blocks; ranges are cut inside and around it."""
    monkeypatch.setattr(warc, "RANGE_BLOCKS", 2)
    rng = random.Random(11)
    rows = [(i, "http://hot.org/" if rng.random() < 0.5 else f"http://{rng.choice('abcdef')}.org/{rng.randrange(30)}", f"<p>{i % 40}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.written_archive(pages, block=7)
    assert sorted(r.page_id for r in warc.captures_at(archive, pages).collect()) == list(range(400))
    some = ["http://hot.org/", "http://a.org/3", "http://zzz.org/"]
    got = warc.captures_at(archive, spark.createDataFrame([(u,) for u in some], "url string")).collect()
    assert sorted(r.page_id for r in got) == [i for i, u, _ in rows if u in some]


def test_pages_that_repeat_an_id(spark):
    rows = [(1, "http://a/", "x"), (1, "http://a/", "x"), (1, "http://b/", "y"), (2, "http://a/", "x")]
    archive = warc.written_archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.records(archive, warc.captures_of(archive)).collect())
    assert got == [(1, "response", None)] * 3 + [(2, "revisit", 1)]


def test_only_letters_make_words(spark):
    assert language.words_of("x² ½ cup, Ⅷ a½b É1 12 _") == ["x", "cup", "a", "b", "é"]
    model = language.train({"en": ["the cat and the dog " * 30], "fr": ["le chat et le chien " * 30]})
    assert [lang for lang in model.predict(["²", "½ 3", "Ⅷ", "12_", ""])[0]] == ["und"] * 5
    rows = [(1, "the dog and the cat", 1, 2), (1, "the dog and the cat", 1, 2), (2, "le chien " * 200_000, 1, 2), (3, "½", 1, 2), (4, "zzz", 1, 2)]
    got = language.predicted(spark.createDataFrame(rows, "doc_id long, text string, score int, held_out int"), model).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in got if r.doc_id < 4) == [(1, "en"), (1, "en"), (2, "fr"), (3, "und")]
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and all(0 <= r.score <= 1 for r in got)
    mixed = language.train({x: [f"{a} {b} " * 300] for x, a, b in (("de", "der", "und"), ("en", "the", "of"), ("es", "la", "que"), ("fr", "les", "dans"))})
    _, (score,), (sure,) = mixed.judged(["der und der und the of the of la que la que les dans les dans"])
    assert score < 0.4 < 0.7 < sure  # four languages, each word sure of its own
    even = language.Model(["aa", "bb"], {}, np.zeros((language.GRAM_ROWS, 2), np.float32), np.zeros((2, 2)))
    assert even.predict(["any words"]) == (["aa"], [0.5])  # a tie goes to the first in order

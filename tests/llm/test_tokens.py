"""Byte-level BPE against tiktoken, packing against the tokenizers library."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe
from tokenizers import Tokenizer

from plumbline.llm import bpe, packing

BPE, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "a", "Hello  world\n\n it's 2024!", "naïve café — 你好 😀 ￿", "x" * 3000, "\x00\x7f<|endoftext|>", "don't DON'T", "ab" * 700 + "\t\n" * 50]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(BPE), special_tokens={})


def test_bpe_is_the_librarys(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10**6 + i, t) for i, t in enumerate(TEXTS)] + [(None, "x")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.round_trip(docs, BPE, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), BPE, public_tokenizers.PATTERN).count() == 0


def test_repeated_rows_and_clashing_names(spark):
    shape = "doc_id long, text string, piece string, used string, open string, n_tokens string, pieces string"
    rows = [(1, "a b c " * 9, *"abcde")] * 3 + [(2, None, *"abcde"), (None, "", *"abcde")]
    docs = spark.createDataFrame(rows, shape)
    got = bpe.round_trip(docs, BPE, public_tokenizers.PATTERN).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 1, 1, 2] and len({r.ids_sha256 for r in got if r.doc_id == 1}) == 1
    packed = packing.sequences(docs, WORDS).collect()
    assert sorted(r.doc_id or 0 for r in packed) == [0, 1, 1, 1, 2] and len({r.sequence_id for r in packed}) == 1
    assert sorted(r.length for r in packed if r.doc_id != 1) == [1, 1]


def test_bins_against_their_bound(spark):
    """Over documents: no more than 1 % above the tokens over the length; slack costs at most its share."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for slack, most in ((packing.SLACK, 1.01), (0, 1.01)):
        got = packing.sequences(docs, WORDS, slack=slack).select("sequence_id", "length").collect()
        bins, bound = len({r.sequence_id for r in got}), -(-sum(r.length for r in got) // packing.LENGTH)
        print(f"slack {slack}: {bins} sequences, bound {bound}")
        assert bins <= most * bound + 1


def test_bpe_appends_and_edits_are_exact():
    model, rng = bpe.text_bpe(BPE, public_tokenizers.PATTERN).model, random.Random(0)
    make = lambda n: bytes(rng.choice(b"abcdeinrst xyz\xc3\xa9") for _ in range(n))
    table = bpe.PrefixTable(model, make(200))
    for _ in range(40):
        at = rng.randrange(len(table.data) + 1)
        end = min(len(table.data), at + rng.randrange(6))
        table.replace(at, end, make(rng.randrange(6)))
        table.append(make(rng.randrange(4)))
        assert table.tokens() == bpe.PrefixTable(model, table.data).tokens()
        assert model.decode(table.tokens()) == table.data


def test_packing_holds_every_id_once(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, "word " * 9000), (50, "word " * 9000), (None, "no id"), (60, "the quick fox " * 2000)]
    rows += [(r.doc_id + 1000, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = packing.sequences(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), WORDS).collect()
    library = Tokenizer.from_file(WORDS)
    want, total = [], 0
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) * 1.02 + 1


@pytest.mark.parametrize("parts", [1, 6])
def test_packing_lets_long_pieces_meet_the_short_ones_that_come_later(spark, parts):
    """Pieces of 11 and then 9 of 20 tokens, far more than a task holds; and a few that only meet later."""
    rows = [(i, "a " * (10 if i < 2000 else 8)) for i in range(4000)]
    got = packing.sequences(spark.createDataFrame(rows, "doc_id long, text string").coalesce(parts), WORDS, 20, 0, 4, 100).collect()
    assert sorted(r.doc_id for r in got) == list(range(4000))
    used = defaultdict(int)
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 20
    assert len(used) <= 2000 * 1.02


def test_packing_leaves_one_bin_up_to_half_full(spark):
    rows = [(i, "a " * 15) for i in range(500)] + [(i, "a " * 6) for i in range(500, 507)]
    got = packing.sequences(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), WORDS, 20, 0, 2, 10).collect()
    used = defaultdict(int)
    for r in got:
        used[r.sequence_id] += r.length
    assert len(got) == 507 and len(used) == 504 and sum(u <= 10 for u in used.values()) == 1


def test_packing_of_nothing(spark):
    assert packing.sequences(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0


def test_word_memory_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 3)
    ids = packing.WordIds(WORDS)
    text = "one two three four one two five six one seven"
    assert ids.encode(text) == ids._ids(text)
    assert ids.encode(text) == ids._ids(text)


def test_groups_are_bounded_by_pieces_as_well_as_bins(spark, monkeypatch):
    """Very many tiny documents: no group has more than its share of pieces, and nothing is lost or packed worse."""
    seen = []
    real = packing.dealt
    monkeypatch.setattr(packing, "dealt", lambda items, groups, gathered, length: seen.append((groups, packing._amount(items))) or real(items, groups, gathered, length))
    docs = spark.range(6000).selectExpr("id doc_id", "repeat('word ', cast(16 + id % 2 as int)) text")
    got = packing.sequences(docs, public_tokenizers.path("word_bpe_49k.json"), most=1000)
    rows = got.collect()
    assert all(held / groups <= 1000 for groups, (_, held) in seen) and len(seen) > 1
    assert sorted(r.doc_id for r in rows) == list(range(6000))
    total = sum(r.length for r in rows)
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= -(-total // 2048) + len(seen) * 6

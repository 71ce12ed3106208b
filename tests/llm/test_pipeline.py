"""The corpus pipeline, stage by stage, against brute force."""

import re

import corpus_pipeline as cp
from test_dedup import brute_exact, brute_near

from plumbline.llm import language, pii
from plumbline.storage import written


def test_stages_keep_what_they_should(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = language.fitted(docs)
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        out = written(stage(spark, docs, sf), f"test-{name}")
        assert out.columns == docs.columns
        kept = {r.doc_id: r for r in out.collect()}
        if k == 0:
            langs, _, sure = model.judged([r.text or "" for r in rows.values()])
            want = {i for i, a, s in zip(rows, langs, sure) if a != "und" and s >= cp.MIN_LANGUAGE_SCORE}
            clean = [i for i, r in rows.items() if r.lang and len(re.findall(r"[^\W\d_]{2,}", r.text or "")) > 30]
            assert len(set(clean) & kept.keys()) >= 0.99 * len(clean)
        elif k == 1:
            want = {i for i, _ in brute_exact([(r.doc_id, r.text) for r in rows.values()])}
        elif k == 2:
            want = {c for _, c in brute_near([(r.doc_id, r.text) for r in rows.values()]).values()}
        else:
            want = set(rows)
            for i, r in rows.items():
                (_, spans), = pii.all_spans([r.text or ""])
                assert kept[i].text == pii.redact(r.text or "", spans) and kept[i].n_chars == len(kept[i].text)
        assert kept.keys() == want
        rows, docs = kept, out
    packed = cp.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == set(rows)


def test_run_of_no_documents(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert cp.run(spark, f"file://{tmp_path}").count() == 0

"""The registered queries of the operators, and SQL where it can state them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, exact_dedup, language, license_texts, licenses, maincontent, near_dedup, packing, periodic_runs, pii, url_rules, vector_codes, warc, winnowing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    archive = warc.written_archive(pages)
    return warc.records(archive, warc.captures_at(archive, pages))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_likeness(_table(spark, sf_dir, "documents"))


def op3_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predicted(docs, language.fitted(docs))


#: host, path, verdict
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judged(_table(spark, sf_dir, "pages"), rules)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(_table(spark, sf_dir, "documents"))


def op6_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_min_cut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maincontent.extracted(_table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(_table(spark, sf_dir, "documents"))


def op10_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_in(_table(spark, sf_dir, "documents"))


def op11_va_file_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(_table(spark, sf_dir, "embeddings"))


def op12_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents")).drop("matches")


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic(_table(spark, sf_dir, "documents")).drop("runs")


QUERIES = {
    "op1_warc_capture_index": op1_warc_capture_index,
    "op2_winnowing": op2_winnowing,
    "op3_crf_language": op3_crf_language,
    "op4_url_rules": op4_url_rules,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_prefix_bpe": op6_prefix_bpe,
    "op7_min_cut_text": op7_min_cut_text,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_crf_pii": op10_crf_pii,
    "op11_va_file_codes": op11_va_file_codes,
    "op12_license_templates": op12_license_templates,
    "op13_lyndon_runs": op13_lyndon_runs,
}


def _codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, width: int = 4) -> str:
    """The rounds written out for vectors of ``parts * width`` components, every part compared with every entry."""
    w = range(width)
    off = " + ".join(f"(p.x{i} - b.x{i}) * (p.x{i} - b.x{i})" for i in w)

    def assigned(k: int) -> str:
        near = f"SELECT p.vec_id, p.part, min(({off}) * {entries} + b.entry) AS best FROM p JOIN b{k} b ON b.part = p.part GROUP BY 1, 2"
        return f"n{k} AS MATERIALIZED (SELECT vec_id, part, best % {entries} AS entry, best // {entries} AS off FROM ({near}))"

    def refined(k: int) -> str:
        means = ", ".join(f"floor(sum(x{i}) / count(*))::BIGINT AS y{i}" for i in w)
        old = ", ".join(f"coalesce(y{i}, x{i}) AS x{i}" for i in w)
        return f"m{k} AS (SELECT part, entry, {means} FROM n{k} JOIN p USING (vec_id, part) GROUP BY 1, 2), b{k + 1} AS MATERIALIZED (SELECT part, entry, {old} FROM b{k} LEFT JOIN m{k} USING (part, entry))"

    steps = ", ".join(x for k in range(vector_codes.ROUNDS) for x in (assigned(k), refined(k)))
    last = vector_codes.ROUNDS
    cells = ", ".join(f"z[part * {width} + {i + 1}] AS x{i}" for i in w)
    return f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS z FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT vec_id, part, {cells} FROM v, range({parts}) AS t(part)),
        f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries}),
        b0 AS MATERIALIZED (SELECT part, entry, {', '.join(f'x{i}' for i in w)} FROM p JOIN f USING (vec_id)),
        {steps}, {assigned(last)},
        h AS (SELECT sha256(string_agg(concat_ws(',', {', '.join(f'x{i}' for i in w)}), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{last}),
        c AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(off)::BIGINT AS error FROM n{last} GROUP BY 1)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN v USING (vec_id), h
    """


def _licenses_sql() -> str:
    """Phrases by comparing lists of words, templates as regular expressions over all words."""
    places = " + ".join(f"len(p{k})" for k in range(len(license_texts.PHRASES)))
    all_places = "list_concat(" * (len(license_texts.PHRASES) - 1) + "p0" + "".join(f", p{k})" for k in range(1, len(license_texts.PHRASES)))

    def where(phrase: str) -> str:
        return f"list_filter(range(len(w)), lambda i: {' AND '.join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(phrase.split()))})"

    found = ", ".join(f"{where(phrase)} AS p{k}" for k, (phrase, _) in enumerate(license_texts.PHRASES))
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(license_texts.PHRASES))
    more = ", ".join(f"CASE WHEN regexp_matches(line, '{licenses.as_regex(template)} ') THEN '{label}' END" for label, template in license_texts.TEMPLATES)
    listed = "list_sort(list_filter({0}, lambda x: x IS NOT NULL))"
    return rf"""
        WITH t AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        f AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line, {found} FROM t),
        l AS (SELECT *, {places} AS n, {all_places} AS ps, {listed.format(f"[{base}]")} AS b, {listed.format(f"[{more}]")} AS m FROM f)
        SELECT doc_id, len(w)::BIGINT AS n_words, n::BIGINT AS n_base, list_min(ps)::BIGINT AS first_word, list_max(ps)::BIGINT AS last_word,
               array_to_string(b, ',') AS base_labels, array_to_string(list_sort(list_concat(b, m)), ',') AS labels,
               CASE WHEN len(m) > 0 THEN 1.0 WHEN len(b) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
        FROM l
    """


ORACLES = {
    "op1_warc_capture_index": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        g AS (
            SELECT page_id, octet_length(encode(html)) AS payload_bytes,
                   min(page_id) OVER (PARTITION BY html) AS first,
                   list_transform(range(8), lambda i: ('0x' || substr(h, i * 5 + 1, 5))::INTEGER) AS v
            FROM p)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(v, lambda x: list_aggregate(list_transform([15, 10, 5, 0],
                   lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> b) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM g
    """,
    "op4_url_rules": """
        WITH r(host, path, verdict) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        s AS (
            SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
        u AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM s),
        f AS (
            SELECT u.*, r.host || r.path AS rule, r.verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
            FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1
    """,
    "op5_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents),
        k AS (
            SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id
            FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
    """,
    "op11_va_file_codes": _codes_sql(),
    "op12_license_templates": _licenses_sql(),
}

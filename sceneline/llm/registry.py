"""The queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from sceneline.llm import bpe, codebooks, fmindex, html_text, ivfpq, jaccard, langid, mixing, pii, quality, sortmeans, topk, vector_sql, warc
from sceneline.llm.common import read

ORACLE_SQL: dict[str, str] = {}


def op1_html_extract(spark, sf_dir):
    return html_text.extract(read(spark, sf_dir, "pages"))


def op2_language_id(spark, sf_dir):
    return langid.identify_table(read(spark, sf_dir, "documents"))


def op3_exact_top_k(spark, sf_dir):
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op4_bpe_encode_decode(spark, sf_dir):
    return bpe.encode_digests(read(spark, sf_dir, "documents"))


def op5_ann_ivfpq(spark, sf_dir):
    return ivfpq.search(read(spark, sf_dir, "embeddings"))


def op6_quality_mil(spark, sf_dir):
    return quality.score_table(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_pii_boosted(spark, sf_dir):
    return pii.detect_table(read(spark, sf_dir, "documents"))


def op8_warc_round_trip(spark, sf_dir):
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard.join_components(read(spark, sf_dir, "documents"))


def op10_mix_sources(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"))


def op11_decontaminate(spark, sf_dir):
    found = fmindex.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op12_sort_means(spark, sf_dir):
    return sortmeans.cluster_table(read(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark, sf_dir):
    return codebooks.compress(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_language_id": op2_language_id,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_bpe_encode_decode": op4_bpe_encode_decode,
    "op5_ann_ivfpq": op5_ann_ivfpq,
    "op6_quality_mil": op6_quality_mil,
    "op7_pii_boosted": op7_pii_boosted,
    "op8_warc_round_trip": op8_warc_round_trip,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_mix_sources": op10_mix_sources,
    "op11_decontaminate": op11_decontaminate,
    "op12_sort_means": op12_sort_means,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL["op3_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE_SQL["op8_warc_round_trip"] = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < kept THEN kept END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)
"""

ORACLE_SQL["op9_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM d
), e AS (SELECT r, len(s) AS n, unnest(s) AS x FROM s
), l AS (
  SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), two AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (SELECT r, doc_id AS m FROM s UNION SELECT two.b, reach.m FROM reach JOIN two ON two.a = reach.r
), c AS (SELECT r, min(m) AS component_id FROM reach GROUP BY r)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN c USING (r)
"""

ORACLE_SQL["op11_decontaminate"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), n AS (SELECT *, least(10, len(w)) AS size FROM b WHERE len(w) > 0
), p AS (SELECT DISTINCT item_id, size, unnest(list_transform(range(1, CAST(len(w) - size + 2 AS BIGINT)), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS g FROM n
), q AS (
  SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM (SELECT r, w, size, unnest(range(1, CAST(len(w) - size + 2 AS BIGINT))) AS i FROM d JOIN (SELECT DISTINCT size FROM n) ON size <= len(w))
), m AS MATERIALIZED (SELECT r, i, size, item_id FROM q JOIN p USING (size, g)
), h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM m) GROUP BY r
), t AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
ORACLE_SQL["op12_sort_means"] = vector_sql.SORT_MEANS
ORACLE_SQL["op13_vector_codes"] = vector_sql.FILTERING

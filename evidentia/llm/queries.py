"""One registered query per operator, over the whole of its table.

``LLM_ORACLES`` has DuckDB SQL where SQL expresses the operator; the others are
tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import (chunk_dedup, decontam, line_quality, mixing, ngram_join, resampling, secret_scan, simhash, toxicity,
                           url_filter, warc_index, whitening, wrapper_html)
from evidentia.llm.common import table

URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
             ("allow", "com/fr/"), ("block", "com/de/"))
MIX_WEIGHTS, MIX_REPEAT = (5, 2, 1), 3


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "score")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_REPEAT)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.captures(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_html.extract_pages(table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_ngram_join": op2_ngram_join,
    "op3_chunk_dedup": op3_chunk_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_source_mix": op5_source_mix,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_html_extract": op10_html_extract,
    "op11_whitening": op11_whitening,
    "op12_resampling": op12_resampling,
    "op13_simhash": op13_simhash,
}

LLM_ORACLES: dict[str, str] = {
    "op2_ngram_join": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM t, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (
  SELECT x, y FROM p JOIN n m ON m.doc_id = x JOIN n o ON o.doc_id = y WHERE 100 * k >= 75 * (m.n + o.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM documents
      UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.c = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) c USING (doc_id)""",
    # whole hash order instead of histograms: the same 36 bits, so the same cut
    "op5_source_mix": r"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n, count(*) OVER () AS k FROM d GROUP BY source),
w AS (SELECT source, n, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
      FROM s),
l AS (SELECT *, (sum(n) OVER () - coalesce(sum(3 * n) OVER (ORDER BY 3 * n / w, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY 3 * n / w, source NULLS LAST
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
f AS (SELECT arg_min(lev, 3 * n / w) AS lev FROM l WHERE lev <= 3 * n / w),
t AS (SELECT source, n, least(3 * n, coalesce((SELECT lev FROM f), 0) * w) AS target FROM l),
r AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS reps FROM t),
b AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
c AS (SELECT b.*, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM b),
e AS (SELECT c.source, c.h, c.words, c.upto, r.target - r.reps * r.n AS budget
      FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source),
x AS (SELECT source, min(h) AS edge, arg_min(words, h) AS words, arg_min(budget - (upto - words), h) AS room
      FROM e WHERE upto > budget GROUP BY source),
y AS (SELECT source, CASE WHEN words < 2 * room THEN edge + 1 ELSE edge END AS cut FROM x)
SELECT d.doc_id, d.size, r.n::BIGINT AS source_size, r.target,
       (least(r.reps + CASE WHEN d.h < coalesce(y.cut, 0) THEN 1 ELSE 0 END, 3) * d.size)::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
       LEFT JOIN y ON d.source IS NOT DISTINCT FROM y.source""",
    "op6_decontaminate": r"""
WITH RECURSIVE w AS (
  SELECT true AS is_doc, doc_id::VARCHAR AS id, text FROM documents
  UNION ALL SELECT false, coalesce(item_id::VARCHAR, 'null'), text FROM benchmark),
t AS (SELECT is_doc, id, coalesce(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM w),
k AS (SELECT DISTINCT least(len(words), 10) AS l FROM t WHERE NOT is_doc AND len(words) > 0),
v AS (SELECT t.is_doc, t.id, k.l, i, array_to_string(words[i:i + k.l - 1], ' ') AS win
      FROM t JOIN k ON t.is_doc OR k.l = least(len(words), 10), unnest(range(1, len(words) - k.l + 2)) AS u(i)),
o AS (SELECT d.id, d.i, d.l, b.id AS item FROM v d JOIN (SELECT DISTINCT id, l, win FROM v WHERE NOT is_doc) b
      ON d.l = b.l AND d.win = b.win WHERE d.is_doc),
h AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + l)) AS p FROM o) GROUP BY id),
m AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
      FROM (SELECT DISTINCT id, item FROM o) GROUP BY id)
SELECT d.doc_id, len(t.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d JOIN t ON t.is_doc AND t.id = d.doc_id::VARCHAR LEFT JOIN h USING (id) LEFT JOIN m USING (id)""",
    "op8_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
}

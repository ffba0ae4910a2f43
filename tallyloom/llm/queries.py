"""The queries of these operators, op1 to op13 and the pipeline, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import centroids, decontamination, fingerprints, html_text, jaccard, line_dedup, merkle, mixing, quality_rules, token_counts, token_files, url_filters, warc

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(spark, token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=END_ID))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_warc(spark, warc.write_warc(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_neighbours(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filters.RULES, "key string, verdict string")
    return url_filters.report(table(spark, sf_dir, "pages"), rules)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.report(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_decontamination, op2_line_dedup, op3_ngram_jaccard, op4_token_files, op5_token_counts, op6_quality_rules, op7_mixing, op8_warc, op9_fingerprints, op10_url_filters, op11_merkle, op12_centroids, op13_html_text, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those that SQL expresses on whole tables; the others are tested against plain versions in tests/llm."""
    return {"op8_warc": WARC_SQL, "op10_url_filters": URL_SQL, "op11_merkle": MERKLE_SQL, "op12_centroids": CENTROIDS_SQL}


WARC_SQL = """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""

URL_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), r AS (
  SELECT *, '.' || host AS dotted FROM h
), m AS (
  SELECT page_id, host, path, CASE
    WHEN dotted LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN dotted LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN dotted LIKE '%.com' AND starts_with(path, '/') THEN 'com/'
    WHEN dotted LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN dotted LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
  END AS rule FROM r
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""

MERKLE_SQL = """
WITH RECURSIVE f AS (
  SELECT doc_id, lang, n_chars, CASE WHEN doc_id IS NULL THEN '-' ELSE length(CAST(doc_id AS VARCHAR)) || ':' || doc_id END AS d,
    CASE WHEN source IS NULL THEN '-' ELSE octet_length(encode(source)) || ':' || source END AS s,
    CASE WHEN lang IS NULL THEN '-' ELSE octet_length(encode(lang)) || ':' || lang END AS l, CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END AS t,
    xor(4294967295, list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) :: BIGINT),
      lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295)) % 7 = 0 AS changed
  FROM documents
), leaves AS (
  SELECT doc_id, lang, changed, sha256(d || s || l || CASE WHEN n_chars IS NULL THEN '-' ELSE length(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || t) AS leaf,
    sha256(d || s || l || CASE WHEN n_chars IS NULL THEN '-' ELSE length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) END || t) AS tampered FROM f
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), tree(lang, level, idx, n, d) AS (
  SELECT lang, 0, idx, n, leaf FROM placed
  UNION ALL
  SELECT lang, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY lang, level, idx // 2, n
), subroots AS (
  SELECT lang, d AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS groups FROM tree WHERE n = 1
), top(level, idx, n, d) AS (
  SELECT 0, place, groups, subroot FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 2, n
), levels AS (
  SELECT p.lang, p.idx, s.subroot, s.height, s.place, unnest(range((SELECT max(level) FROM top) + s.height)) AS level FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
), steps AS (
  SELECT v.lang, v.idx, v.level, coalesce(CASE WHEN (v.idx >> v.level) & 1 = 1 THEN 'l' ELSE 'r' END || t.d, '-') AS step FROM levels v
  LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM v.lang AND t.level = v.level AND t.idx = xor(v.idx >> v.level, 1) WHERE v.level < v.height
  UNION ALL
  SELECT v.lang, v.idx, v.level, coalesce(CASE WHEN (v.place >> (v.level - v.height)) & 1 = 1 THEN 'l' ELSE 'r' END || t.d, '-') FROM levels v
  LEFT JOIN top t ON t.level = v.level - v.height AND t.idx = xor(v.place >> (v.level - v.height), 1) WHERE v.level >= v.height
), proofs AS (
  SELECT lang, idx, string_agg(substr(step, 2), '' ORDER BY level) AS siblings, list(step ORDER BY level) AS path FROM steps GROUP BY lang, idx
), folded AS (
  SELECT p.doc_id, p.leaf, s.subroot, (SELECT d FROM top WHERE n = 1) AS root, sha256(coalesce(q.siblings, '')) AS proof_sha256,
    list_reduce(coalesce(q.path, []), lambda c, x: sha256(CASE substr(x, 1, 1) WHEN 'l' THEN substr(x, 2) || c WHEN 'r' THEN c || substr(x, 2) ELSE c END), CASE WHEN p.changed THEN p.tampered ELSE p.leaf END) AS folded_root
  FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang LEFT JOIN proofs q ON q.lang IS NOT DISTINCT FROM p.lang AND q.idx = p.idx
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

CENTROIDS_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c(round, j, x) AS (
  SELECT 0, row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1, x FROM (SELECT * FROM v ORDER BY sha256('3:' || vec_id), x LIMIT 8)
  UNION ALL
  SELECT round + 1, j, coalesce(list(part ORDER BY place) FILTER (WHERE place > 0), any_value(x)) FROM (
    SELECT c.round, c.j, c.x, s.place, (s.total - (s.total % s.n + s.n) % s.n) // s.n AS part FROM c LEFT JOIN (
      SELECT j, place, sum(component) AS total, count(*) AS n FROM (
        SELECT j, unnest(x) AS component, unnest(range(1, 65)) AS place FROM (
          SELECT v.x, arg_min(c.j, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) * 8 + c.j) AS j FROM v, c GROUP BY v.vec_id, v.x
        )
      ) GROUP BY j, place
    ) s ON s.j = c.j
  ) WHERE round < 10 GROUP BY round, j
), d AS (
  SELECT v.vec_id, min(CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) * 8 + c.j) AS near FROM v, c WHERE c.round = 10 GROUP BY v.vec_id, v.x
)
SELECT d.vec_id, CAST(d.near % 8 AS INTEGER) AS cluster, CAST(d.near // 8 AS BIGINT) AS distance, CAST(sum(d.near // 8) OVER (PARTITION BY d.near % 8) AS BIGINT) AS cluster_inertia,
  CAST(sum(d.near // 8) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM d JOIN c ON c.round = 10 AND c.j = d.near % 8
"""

"""The queries op1 to op13 over the intended tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import fingerprints, language_id, lattice_dedup, mixing, packing, quality, rolling_users, simhash, substring_dedup, suffix_dedup, token_store, url_filter, whitening

#: The rules of op10: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", language_id.held_out(found["doc_id"]).alias("held_out"), "lang_pred", "score", "accepted")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_documents(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), "byte", 2)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("row")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"('{host}', '{path}', '{verdict}')" for verdict, host, path in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {rows} AS r(host, path, verdict)")
    return url_filter.judge(_table(spark, sf_dir, "pages"), rules)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op13_rolling_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_users.rolling_users(_table(spark, sf_dir, "clicks"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    every = [op1_substring_dedup, op2_language_id, op3_document_fingerprints, op4_token_ids, op5_mixing, op6_quality_classifier, op7_embedding_near_dedup, op8_simhash_near_dedup, op9_packing, op10_url_filters, op11_embedding_whitening, op12_suffix_array_dedup, op13_rolling_users, pipeline]
    return {f.__name__: f for f in every}


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), win AS (
  SELECT doc_id, pos, sha256(array_to_string(w[pos:pos + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS pos FROM d WHERE len(w) >= 50)
), hit AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY h) AS low FROM win) WHERE doc_id > low
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + 49)) AS i FROM hit
), g AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
    list_transform(list_filter(generate_series(1, len(w)), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

OP10_SQL = r"""
WITH rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
p AS (
  SELECT page_id, row_number() OVER () AS n,
    lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')) AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), m AS (
  SELECT p.*, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY n ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


OP12_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents
), win AS (
  SELECT doc_id, r, i, md5(substr(x, 2 * i + 1, 200)) AS h
  FROM (SELECT doc_id, r, x, unnest(generate_series(0, length(x) // 2 - 100)) AS i FROM d WHERE length(x) >= 200)
), hit AS (
  SELECT r, i FROM (
    SELECT doc_id, r, i, min(doc_id) OVER (PARTITION BY h) AS low, min(i) OVER (PARTITION BY h, r) AS early FROM win)
  WHERE doc_id > low OR i > early
), run AS (
  SELECT r, min(i) AS a, max(i) + 100 AS z
  FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k
        FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM hit))
  GROUP BY r, k
), piece AS (
  SELECT d.r, a, substr(x, 2 * a + 1, 2 * (z - a)) AS gone,
    substr(x, 2 * coalesce(lag(z) OVER (PARTITION BY d.r ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(z) OVER (PARTITION BY d.r ORDER BY a), 0))) AS kept
  FROM d JOIN run ON d.r = run.r
), g AS (
  SELECT r, count(*) AS spans, sum(length(gone)) // 2 AS removed, string_agg(kept, '' ORDER BY a) AS kept, sum(length(gone) + length(kept)) AS upto
  FROM piece GROUP BY r
)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, CAST(coalesce(upto, 0) AS BIGINT) + 1))) AS kept_sha256
FROM d LEFT JOIN g ON d.r = g.r
"""

OP13_SQL = """
WITH one AS (
  SELECT min((epoch_us(ts) // 60000000, kind, client_id)) AS c
  FROM (SELECT *, row_number() OVER () AS r FROM clicks WHERE ts IS NOT NULL AND kind IS NOT NULL)
  GROUP BY click_id, CASE WHEN click_id IS NULL THEN r END
), c AS (
  SELECT c[2] AS kind, CAST(c[1] AS BIGINT) AS minute, c[3] AS client FROM one
), m AS (
  SELECT DISTINCT kind, minute FROM c
), u AS (
  SELECT m.kind, m.minute, c.client, count(*) AS n, max(c.minute) AS latest
  FROM m JOIN c ON m.kind = c.kind AND c.minute BETWEEN m.minute - 10079 AND m.minute
  WHERE c.client IS NOT NULL GROUP BY ALL
)
SELECT m.kind, m.minute, count(*) FILTER (latest > m.minute - 5) AS users_short, count(*) FILTER (latest > m.minute - 30) AS users_middle,
  count(client) AS users_long, count(*) FILTER (n >= 3) AS hot_users
FROM m LEFT JOIN u ON m.kind = u.kind AND m.minute = u.minute GROUP BY m.kind, m.minute
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op10_url_filters": OP10_SQL, "op12_suffix_array_dedup": OP12_SQL, "op13_rolling_users": OP13_SQL}

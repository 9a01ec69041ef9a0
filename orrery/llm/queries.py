"""Registered queries of this subpackage: thin applications of each operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.session import read_table

from . import best_fit_packing, decontaminate, embedding_whitening, exact_dedup, lexical_search, maxent_lm, quality_bayes, secret_ledger, shuffle_shards, simhash_anchors, substring_dedup, suffix_dedup, url_filter


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(read_table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(read_table(spark, sf_dir, "documents"))


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.secret_report(read_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), passage=(240, 50))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_shards.shard_documents(read_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op8_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bayes.quality_verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_anchors.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score_documents(read_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whitening_report(read_table(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_report(read_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_exact_dedup, op3_secret_ledger, op4_suffix_dedup, op5_decontaminate,
        op6_shuffle_shards, op7_best_fit_packing, op8_quality_bayes, op9_simhash_anchors, op10_maxent_lm,
        op11_embedding_whitening, op12_substring_dedup, op13_lexical_search,
    )
}

ORACLE = {
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op3_secret_ledger": r"""
WITH rules(kind, name, pattern, grp, least) AS (VALUES
       (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
       (1, 'access', 'AKIA[A-Z0-9]+', 0, 16), (2, 'hex', '[0-9a-f]+', 0, 32)),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT doc_id, 0 AS kind, string_split_regex(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS skip,
         regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS whole,
         regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS part FROM docs
  UNION ALL SELECT doc_id, 1, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM docs
  UNION ALL SELECT doc_id, 2, string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+') FROM docs),
each AS (
  SELECT doc_id, kind, unnest(range(1, len(whole) + 1)) AS i, unnest(whole) AS w, unnest(part) AS p, unnest(skip[1:len(whole)]) AS s FROM cut WHERE len(whole) > 0),
placed AS (
  SELECT doc_id, kind, sum(length(w) + length(s)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop, length(w) AS n, length(p) AS k FROM each),
good AS (
  SELECT doc_id, placed.kind, name, stop - n AS start, stop FROM placed JOIN rules USING (kind) WHERE k >= least),
spans AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
         string_agg(name || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind) AS spans FROM good GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN spans USING (doc_id)
""",
    "op4_suffix_dedup": r"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
strings AS (SELECT k, size, s, hash(x[s + 1:s + size]) AS h FROM (SELECT k, size, x, unnest(range(0, n - size + 1)) AS s FROM docs, (VALUES (400), (240)) v(size) WHERE n >= size)),
again AS (SELECT k, size, s FROM strings QUALIFY count(*) OVER (PARTITION BY size, h) > 1),
marked AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY k, size ORDER BY s) + size THEN 0 ELSE 1 END AS fresh FROM again),
runs AS (SELECT k, size, min(s) AS a, max(s) + size AS z FROM (SELECT *, sum(fresh) OVER (PARTITION BY k, size ORDER BY s) AS run FROM marked) GROUP BY k, size, run),
pieces AS (
  SELECT k, coalesce(lag(z) OVER (PARTITION BY k ORDER BY a), 0) AS a, a AS z FROM runs WHERE size = 400
  UNION ALL SELECT docs.k, coalesce(max(z), 0), any_value(n) FROM docs LEFT JOIN runs ON runs.k = docs.k AND size = 400 GROUP BY docs.k),
kept AS (SELECT k, sha256(unhex(string_agg(hex(x[a + 1:z]), '' ORDER BY a))) AS sha FROM pieces JOIN docs USING (k) GROUP BY k),
cut AS (SELECT k, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs WHERE size = 400 GROUP BY k),
passages AS (
  SELECT k, count(*) FILTER (len(list_filter(string_split(regexp_replace(regexp_replace(hex(x[a + 1:z]), '(..)', '\1 ', 'g'), '(20|09|0A|0B|0C|0D) ', '|', 'g'), '|'), lambda y: y <> '')) > 50) AS n_passages
  FROM runs JOIN docs USING (k) WHERE size = 240 GROUP BY k)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha AS kept_sha256, coalesce(n_passages, 0) AS n_passages
FROM docs JOIN kept USING (k) LEFT JOIN cut USING (k) LEFT JOIN passages USING (k)
""",
    "op5_decontaminate": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS win, least(len(w), 10) AS n
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes)),
met AS (SELECT doc_id, s, n, item_id FROM grams JOIN wins USING (win, n)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM met) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op12_substring_dedup": r"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS k, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT k, s, hash(w[s:s + 19]) AS h FROM (SELECT k, w, unnest(range(1, len(w) - 18)) AS s FROM docs WHERE len(w) >= 20)),
again AS (SELECT k, s FROM windows QUALIFY row_number() OVER (PARTITION BY h ORDER BY k, s) > 1),
gone AS (SELECT k, list(DISTINCT p) AS places FROM (SELECT k, unnest(range(s, s + 20)) AS p FROM again) GROUP BY k),
cut AS (SELECT k, n, len(w) AS n_words, list_filter(w, lambda x, i: NOT list_contains(places, i)) AS kept FROM (SELECT k, w, places, len(places) AS n FROM docs JOIN gone USING (k)))
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(array_to_string(coalesce(kept, w), ' '), '')) AS kept_sha256
FROM docs LEFT JOIN cut USING (k)
""",
    "op13_lexical_search": r"""
WITH dw AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
total AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM dw WHERE len(w) > 0),
asked AS (SELECT q, item_id, t, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS t FROM bw) GROUP BY ALL),
post AS (SELECT r, n, t, count(*) AS tf FROM (SELECT r, len(w) AS n, unnest(w) AS t FROM dw) SEMI JOIN asked USING (t) GROUP BY ALL),
lists AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM post GROUP BY t), total),
impacts AS (SELECT r, t, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)) AS f FROM post, total),
scores AS (SELECT q, item_id, r, sum(times * w * f)::BIGINT AS score FROM asked JOIN lists USING (t) JOIN impacts USING (t) GROUP BY q, item_id, r),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST, r)::INT AS rank, doc_id, score FROM scores JOIN dw USING (r) WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
""",
}

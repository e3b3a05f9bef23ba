"""Queries of the corpus operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fpindex, html, linededup, quality, simhash, tokencount, toxicity, urls
from .common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.rules_frame(spark))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", F.col("n_lines_removed").alias("n_removed"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fpindex.dedup_substrings(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_quality_rules, op3_decontamination, op4_simhash, op5_url_filters, op6_bpe, op7_line_dedup, op8_token_counts, op9_toxicity, op10_substring_dedup)}

_PHRASES = " OR ".join(f"contains(lower(line), '{p}')" for p in quality.BOILERPLATE)
_SQL_CLOSED = quality.CLOSED.replace("'", "''")
_WS = r"[\x20\x09-\x0D]"

ORACLE_SQL = {
    "op5_url_filters": """
WITH cut AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
judged AS (
  SELECT c.page_id, c.host, c.path,
         (SELECT struct_pack(rule := rule_host || rule_path, verdict := verdict) FROM rules
          WHERE (c.host = rule_host OR ends_with(c.host, '.' || rule_host)) AND starts_with(c.path, rule_path)
          ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC LIMIT 1) AS best
  FROM cut c)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
""",
    "op2_quality_rules": rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, text, list_filter(string_split_regex(text, '{_WS}+'), lambda w: w <> '') AS w FROM docs),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM windows) WHERE n > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, list_filter(string_split_regex(line, '{_WS}+'), lambda w: w <> '') AS lw
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)),
judged AS (
  SELECT doc_id, length(regexp_replace(line, '{_WS}', '', 'g')) AS n,
         NOT (regexp_matches(line, '{_SQL_CLOSED}') OR regexp_matches(line, '{quality.SENTENCES}'))
         OR len(list_filter(lw, lambda x: regexp_matches(x, '{quality.MARKS}'))) > 0.3 * len(lw)
         OR regexp_matches(line, '{quality.NAVIGATION}') OR {_PHRASES} AS fails, line
  FROM lines WHERE len(lw) > 0),
by_doc AS (
  SELECT doc_id, sum(n) AS all_chars, coalesce(sum(n) FILTER (fails), 0) AS lost, count(*) - count(DISTINCT line) AS n_dup_lines FROM judged GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '{_WS}', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(b.n_dup_lines, 0) AS n_dup_lines, coalesce(r.n_repeat_words, 0) AS n_repeat_words,
         CASE WHEN b.all_chars > 0 THEN b.lost::DOUBLE / b.all_chars ELSE 0 END AS lost_share
  FROM words d LEFT JOIN repeated r USING (doc_id) LEFT JOIN by_doc b USING (doc_id)),
verdicts AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND lost_share <= 0.5 AS kept
FROM verdicts
""",
    "op10_substring_dedup": rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
}

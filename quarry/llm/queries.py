"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, html_text, langid, lm, mixing, neardup, quality, secrets, substring
from .common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op7_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def secrets_sql() -> str:
    """The SQL of op4: the same patterns and rules, over places summed from what lies between matches."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    parts = []
    for order, (kind, pattern, group, least) in enumerate(secrets.BASE + secrets.ADDED):
        value = f"regexp_extract(h, {quoted(pattern)}, {group})" if group else "h"
        parts.append(
            f"SELECT r, owner, repo, '{kind}' AS kind, {order} AS o, s, s + length(h) AS e, {value} AS v FROM (SELECT r, owner, repo, hits[i] AS h, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s "
            f"FROM (SELECT r, owner, repo, hits, gaps, unnest(generate_series(1, len(hits))) AS i FROM (SELECT r, owner, repo, regexp_extract_all(t, {quoted(pattern)}) AS hits, string_split_regex(t, {quoted(pattern)}) AS gaps FROM d) WHERE len(hits) > 0)) WHERE length({value}) >= {least}"
        )
    n, base = len(secrets.BASE), "o < " + str(len(secrets.BASE))
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o)"
    return (
        "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repo FROM documents), "
        f"spans AS ({' UNION ALL '.join(parts)}), held AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM spans GROUP BY v), "
        f"judged AS (SELECT s.*, owners <= {secrets.MOST_OWNERS} AND repos <= {secrets.MOST_REPOS} AND regexp_matches(s.v, '[0-9]') AND regexp_matches(s.v, '[A-Za-z]') AND len(list_distinct(string_split(s.v, ''))) >= {secrets.LEAST_DISTINCT} AS live FROM spans s JOIN held USING (v)) "
        f"SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, sha256(coalesce({listed} FILTER (WHERE {base}), '')) AS base_sha256, coalesce({listed} FILTER (WHERE o < {n} OR live), '') AS spans, "
        "count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE kind IS NOT NULL AND NOT live) AS n_example FROM d LEFT JOIN judged USING (r) GROUP BY d.r, d.doc_id"
    )


_ALL = (op1_minhash_near_dedup, op2_language_id, op3_html_extraction, op4_secret_scans, op5_document_fingerprints, op6_quality_rules, op7_bpe_encoding, op8_source_mixing, op9_substring_dedup, op10_lm_scoring)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op4_secret_scans": secrets_sql()}

"""The corpus operators as queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomhouse.llm.shared import bucket_of, table

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomhouse.llm.lm_scoring import score_texts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = bucket_of(F.col("doc_id"), 7) == 2
    return score_texts(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomhouse.llm.url_filters import filter_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    from loomhouse.llm.decontamination import find_leaks

    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomhouse.llm.exact_dedup import mark_copies

    return mark_copies(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomhouse.llm.source_mixing import plan_mix

    plan = plan_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep_text=False)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC archives against a replica in which every 97th page has its first letter e changed and every 89th is missing."""
    from loomhouse.llm.shared import written
    from loomhouse.llm.warc_fixity import archived, audit

    placed = written(archived(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("archive", "offset", "length", "page_id", "record"), "warc")
    spoilt = F.when(F.col("page_id") % 97 == 0, F.regexp_replace(F.col("record").cast("string"), "(?s)^(.*?)e", "$1E").cast("binary")).otherwise(F.col("record"))
    replica = placed.filter("page_id is null or page_id % 89 <> 0").withColumn("record", spoilt)
    found = audit(placed.select("archive", "offset", "record"), replica.select("archive", "offset", "record"))
    return found.join(placed.select("archive", "offset", "page_id"), ["archive", "offset"]).select("page_id", "state", "length", "digest", "other_length", "other_digest")


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomhouse.llm.simhash_golay import near_groups

    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomhouse.llm.language_id import identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held_out = bucket_of(F.col("doc_id"), 5) == 0
    return identify(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomhouse.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomhouse.llm.token_output import tokens_of

    return tokens_of(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "start", "n_tokens", "ids_crc32")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: A run of words, as DuckDB's regular expressions have it.
_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]+"

ORACLE = {
    "op2_url_filters": r"""
        WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        hosts AS (SELECT page_id, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM cut),
        parts AS (
            SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(coalesce(rest, ''), length(raw) + 1), '^[^?#]*') AS path FROM hosts),
        rules(rule_host, rule_path, action) AS (VALUES %s)
        SELECT page_id, host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
               coalesce(max_by(action, length(rule_host || rule_path)), 'allow') AS verdict
        FROM (SELECT row_number() OVER () AS n, * FROM parts)
        LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        GROUP BY n, page_id, host, path
    """
    % ", ".join(map(str, URL_RULES)),
    "op4_exact_dedup": rf"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS text_sha256 FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS nth FROM d)
        SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY nth) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size, nth = 1 AS kept, text_sha256 FROM r
    """,
    "op6_warc_fixity": r"""
        WITH r AS (
            SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:loomhouse:' || coalesce(page_id::VARCHAR, 'none') || '>'
                   || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
                   || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
            FROM pages),
        p AS (
            SELECT *, page_id % 89 = 0 AS gone, CASE WHEN page_id % 97 = 0 THEN substr(record, 1, instr(record, 'e') - 1) || 'E' || substr(record, instr(record, 'e') + 1) ELSE record END AS other
            FROM r WHERE page_id % 97 = 0 OR page_id % 89 = 0)
        SELECT page_id, CASE WHEN gone THEN 'missing' ELSE 'corrupt' END AS state, strlen(record) AS length, sha256(record) AS digest,
               CASE WHEN NOT gone THEN strlen(other) END AS other_length, CASE WHEN NOT gone THEN sha256(other) END AS other_digest
        FROM p
    """,
    "op5_source_mixing": rf"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::HUGEINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) %% 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
        c AS (
            SELECT *, 3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER q, 0) AS excess, sum(weight) OVER () - coalesce(sum(weight) OVER q, 0) AS free
            FROM w WINDOW q AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT arg_min(excess, source_size::DOUBLE / weight)::DOUBLE / (2 * arg_min(free, source_size::DOUBLE / weight))::DOUBLE AS level FROM c WHERE weight * excess <= 4 * source_size * free),
        t AS (SELECT source, source_size::BIGINT AS source_size, CASE WHEN weight * excess > 4 * source_size * free THEN source_size * 2.0::DOUBLE ELSE weight * level END::DOUBLE AS target FROM c, l),
        r AS (
            SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                   ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken FROM r
    """.replace("%%", "%"),
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

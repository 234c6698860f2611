"""One query per corpus operator over its whole table, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.llm import bpe, dart_minhash, fingerprints, html_extract, lattice, line_dedup, merkle, mixing, pii, quality, search, token_counts, urls
from quotelens.llm.common import read, staging, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(read(spark, sf_dir, "documents"))


@query
def op2_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return lattice.score_documents(documents, public_tokenizers.path(lattice.VOCABULARY), staging(spark))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judge_documents(documents).drop("text", "lang", "char_distance", "word_distance")


ORACLES["op3_quality_rules"] = f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
FROM ({quality.judge_sql()})
"""

#: Tokens beyond which a document is flagged.
TOKEN_LIMIT = 2048


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(token_counts.VOCABULARY)
    documents = read(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), "text"
    )
    counted = token_counts.count_tokens(documents, path, staging(spark))
    return counted.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit")
    )


@query
def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_pages(pages).withColumn("n_chars", F.length("text").cast("long"))


#: Host, path and verdict of the rules.
URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op6_url_filter"] = """
WITH parts AS (
    SELECT row_number() OVER () AS n, page_id,
           CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), split AS (
    SELECT n, page_id,
           translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
    FROM parts
), rules(h, p, verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
           ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fitting AS (
    SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
    FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN fitting USING (n)
"""


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(documents, staging(spark))
    text = text_of()
    return kept.select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.length(text).cast("long").alias("n_chars"),
        F.sha2(text, 256).alias("text_sha256"),
    )


LINES_SQL = """
texts AS (
    SELECT doc_id, coalesce(text, '') AS t FROM documents
), lines AS (
    SELECT doc_id, i, ls[i] AS line, regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+') AS ws
    FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
          FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM texts))
), kinds AS (
    SELECT ws, min((doc_id, i)) AS first FROM lines WHERE len(ws) >= 5 GROUP BY ws
), cut AS (
    SELECT ws, first, p, ws[:p - 1] || ws[p + 1:] AS v
    FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS p FROM kinds)
), near AS (
    SELECT ws FROM (SELECT ws, first, min(first) OVER (PARTITION BY v, p) AS lead FROM cut) WHERE lead < first
    UNION SELECT c.ws FROM cut c JOIN kinds k ON c.v = k.ws WHERE k.first < c.first
    UNION SELECT k.ws FROM kinds k JOIN cut c ON c.v = k.ws WHERE c.first < k.first
), removed AS (
    SELECT doc_id, i FROM lines l JOIN kinds k USING (ws)
    WHERE (l.doc_id, l.i) > k.first OR ws IN (SELECT ws FROM near)
), rest AS (
    SELECT doc_id, count(*) AS n_lines, count(r.i) AS n_removed,
           coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE r.i IS NULL), '') AS t
    FROM lines l LEFT JOIN removed r USING (doc_id, i) GROUP BY doc_id
), deduped AS (
    SELECT doc_id, n_lines, n_removed,
           CASE WHEN n_removed > 0 AND NOT regexp_matches(t, '[^\x20\x09-\x0D]') THEN '' ELSE t END AS t
    FROM rest
)"""
ORACLES["op7_line_dedup"] = f"""
WITH {LINES_SQL}
SELECT doc_id, n_lines, n_removed, length(t) AS n_chars, sha256(t) AS text_sha256 FROM deduped
"""


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    # Its tables go when the JVM ends: the caller reads the result after this returns.
    classes = dart_minhash.near_duplicate_classes(documents, staging(spark))
    return classes.select(
        "doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept")
    )


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(
        read(spark, sf_dir, "documents"), public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN
    )


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    mixed = mixing.mix_documents(documents, staging(spark), drop=["text"])
    return mixed.select(
        "doc_id", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "sampled"
    )


ORACLES["op10_mixing"] = mixing.mix_sql()


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), staging(spark))


ORACLES["op11_ranked_search"] = search.search_sql()


@query
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digests(pii.find(documents, pii.trained(spark)))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(read(spark, sf_dir, "documents"), staging(spark))


ORACLES["op13_merkle_manifest"] = merkle.audit_sql()

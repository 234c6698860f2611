"""URL rules by hashed host-suffix and path-prefix expressions.

Every URL is expanded into the expressions ``host suffix + path prefix`` that a
rule of the table could have, and joined to the rules on the first four bytes of
the SHA-256 of both. The full digests are compared next, so that a chance match
of the prefix decides nothing, and of the rules that fit the longest one wins.
Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.llm.common import free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``, null if there is none."""
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """From after ``://`` to the first ``/``, ``?`` or ``#``, A to Z in lower case."""
    host = F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From after the host to the first ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def short(digest_: Column) -> Column:
    """The first four bytes of a digest, as a number."""
    return F.conv(F.substring(digest_, 1, 8), 16, 10).cast("long")


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All pairs of a suffix of so many labels and a prefix of so many characters."""
    found = F.array(
        *[
            F.when(
                (_labels(host) >= n) & (F.length(path) >= m) & (F.length(host) > 0),
                F.struct(
                    F.substring_index(host, ".", -n).alias("suffix"), F.left(path, F.lit(m)).alias("prefix")
                ),
            )
            for n in labels
            for m in lengths
        ]
    )
    return F.array_compact(found.cast("array<struct<suffix:string,prefix:string>>"))


def judge_urls(
    df: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow"
) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict`` of each URL.

    ``rules``: ``host``, ``path`` and ``verdict``. A rule fits its host and all
    subdomains, if the path begins with the rule's. The longest rule wins, by the
    characters of host and path together, then of the host; of equal rules a
    block. A URL that no rule fits gets ``otherwise`` and a null rule. Null URLs
    and those without ``://`` have an empty host, which no rule fits. Columns of
    ``df`` with the added names are replaced.

    The verdict hangs on the URL alone, so distinct URLs are judged, and a URL or
    host that fills a third of the rows costs one row per map task. Only the
    numbers of labels and the lengths of paths that some rule has are expanded;
    these two short lists are all that reaches the driver. Expressions are
    distinct as well before they meet the rules; so each rule's key is joined
    once, not once per URL of its host.
    """
    added = ("host", "path", "rule", "verdict")
    kept = [c for c in df.columns if c not in added or c == url]
    # Rules are made distinct, blocks before allows, and hashed like the expressions.
    hashed = (
        rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull() & (F.col("host") != ""))
        .groupBy(F.translate("host", UPPER, LOWER).alias("suffix"), F.col("path").alias("prefix"))
        .agg(F.max(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("blocks"))
        .withColumn("full", digest(F.concat_ws("\n", "suffix", "prefix")))
        .select(
            short(F.col("full")).alias("short"),
            F.col("full").alias("rule_full"),
            F.concat("suffix", "prefix").alias("rule"),
            F.length("suffix").alias("suffix_length"),
            F.when(F.col("blocks") == 1, "block").otherwise("allow").alias("verdict"),
        )
    )
    sizes = rules.select(
        F.collect_set(_labels(F.col("host"))).alias("labels"),
        F.collect_set(F.length("path")).alias("lengths"),
    ).first()
    host, path = host_of(F.col(url)), path_of(F.col(url))
    parts = df.select(host.alias("host"), path.alias("path")).distinct()
    each = parts.withColumn(
        "e", F.explode(expressions(F.col("host"), F.col("path"), sorted(sizes.labels), sorted(sizes.lengths)))
    )
    wanted = F.concat_ws("\n", "e.suffix", "e.prefix")
    asked = each.select(digest(wanted).alias("full")).distinct()
    asked = asked.withColumn("short", short(F.col("full")))
    # Short prefixes find the candidates, full digests confirm them.
    confirmed = asked.join(hashed, "short").filter(F.col("full") == F.col("rule_full"))
    best = (
        each.select("host", "path", digest(wanted).alias("full"))
        .join(confirmed, "full")
        .groupBy("host", "path")
        .agg(
            F.max(F.struct(F.length("rule").alias("n"), F.col("suffix_length"), "rule", "verdict")).alias("b")
        )
        .select("host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("verdict"))
    )
    h, p = free_name(df, "__host", "__path")
    judged = df.select(*[F.col(c) for c in kept], host.alias(h), path.alias(p))
    on = (judged[h] == best["host"]) & (judged[p] == best["path"])
    return judged.join(best, on, "left").select(
        *[judged[c] for c in kept if c not in added],
        F.col(h).alias("host"),
        F.col(p).alias("path"),
        best["rule"],
        F.coalesce(best["verdict"], F.lit(otherwise)).alias("verdict"),
    )

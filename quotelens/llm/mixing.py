"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells of source, language and topic. Token weights of
the cells are raked: scaled to the target of each source, then of each language,
then of each topic, ``SWEEPS`` times over. A document's probability is its cell's raked weight
per token times a number that makes the sample hold ``KEEP`` of all tokens; it is
at most 1, as no document is repeated, and what such cells fall short the others
make up in proportion. Its draw is a hash of its id, so a re-run task draws alike.

A target is a share per value of a column; without one it is the share of the
tokens to the power ``TEMPER``, which lifts what is rare. Values that a given
target does not name get no weight. Null is a value of its own, ``NONE``.
Documents without a token weigh nothing and are not sampled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.llm.common import WORD, free_name, text_of
from quotelens.llm.quality import LETTERS, SYMBOLS
from quotelens.sources.staging import Staging

SWEEPS = 6
#: Share of the tokens to sample, and the rounds in which probabilities are calibrated to it.
KEEP = 0.6
ROUNDS = 8
TEMPER = 0.5
NONE = "(none)"
SEED = "mix"
MARGINS = ("source", "lang", "topic")


def n_tokens_of(text: Column) -> Column:
    """The number of words of a text."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def topic_of(text: Column, n_words: Column) -> Column:
    """A coarse topic by rule, as the documents have no topic of their own: what the text is made of, then its length."""
    n = F.length(text)

    def share(characters: str) -> Column:
        return n - F.length(F.translate(text, characters, ""))

    return (
        F.when(10 * share("0123456789") > n, "numbers")
        .when(10 * share(SYMBOLS) > n, "symbols")
        .when(3 * share(LETTERS.upper()) > n, "capitals")
        .when(n_words < 100, "short")
        .when(n_words < 1000, "medium")
        .otherwise("long")
    )


def _targets(cells: DataFrame, margin: str, given: Mapping[str, float] | None) -> DataFrame:
    """``margin`` with the share ``target`` of each value; shares of the values that exist add up to one."""
    present = cells.groupBy(margin).agg(F.sum("tokens").alias("n")).filter("n > 0")
    if given is None:
        weighed = present.select(margin, F.pow(F.col("n").cast("double"), F.lit(TEMPER)).alias("x"))
    else:
        shares = cells.sparkSession.createDataFrame(list(given.items()), f"{margin} string, x double")
        weighed = present.join(shares, margin, "left").select(margin, F.coalesce("x", F.lit(0.0)).alias("x"))
    return weighed.select(margin, (F.col("x") / _sum(weighed, "x")).alias("target"))


def _sum(df: DataFrame, column: str) -> Column:
    """The sum of a column, as a constant; 1 where there is nothing to divide."""
    return F.lit(float(df.agg(F.sum(column)).first()[0] or 1.0))


def raked_cells(
    df: DataFrame,
    staging: Staging,
    margins: Sequence[str] = MARGINS,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    sweeps: int = SWEEPS,
    keep: float = KEEP,
) -> DataFrame:
    """The ``margins`` of each cell with its ``tokens``, its raked ``weight`` and ``probability``.

    ``df``: the margins, without nulls, and ``tokens``. Cells are summed in the map
    tasks first, so a source of a third of all rows is a few rows by then. Every
    sweep is a few joins and sums over cells, written to the shared folder.
    """
    cells = df.groupBy(*margins).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    cells = staging.table(cells, "cells")
    wanted = {m: staging.table(_targets(cells, m, (targets or {}).get(m)), f"target_{m}") for m in margins}
    whole = _sum(cells, "tokens")
    weights = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(sweeps):
        for m in margins:
            sums = weights.groupBy(m).agg(F.sum("weight").alias("now"))
            scale = sums.join(wanted[m], m).select(
                m, F.when(F.col("now") > 0, F.col("target") * whole / F.col("now")).otherwise(0.0).alias("scale")
            )
            weights = weights.join(scale, m).withColumn("weight", F.col("weight") * F.col("scale")).drop("scale")
        weights = staging.table(weights.select(*margins, "tokens", "weight"), "weights")
    scale = 0.0
    for _ in range(ROUNDS):
        # Cells that reach 1 give all they have; the others share what is left.
        full = F.col("weight") / F.col("tokens") * scale >= 1
        sums = weights.agg(
            F.sum("tokens").alias("whole"),
            F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("given"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if sums.open:
            scale = (keep * sums.whole - sums.given) / sums.open
    chance = F.least(F.lit(1.0), F.col("weight") / F.col("tokens") * scale)
    return weights.select(*margins, "tokens", "weight", chance.alias("probability"))


def draw(key: Column, seed: str = SEED) -> Column:
    """A number from 0 to below 1 by hash of ``key``."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 4294967296.0


#: Columns that are added.
ADDED = ("topic", "n_tokens", "probability", "sampled")


def mix_documents(
    df: DataFrame,
    staging: Staging,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    sweeps: int = SWEEPS,
    drop: Sequence[str] = (),
) -> DataFrame:
    """``df`` with ``topic``, ``n_tokens``, ``probability`` and whether it is ``sampled``.

    Columns of those names are replaced. Draws go by ``doc_id``, or the text where
    it is null; repeated rows are drawn alike. Texts are gone over once: what is
    counted in them is written beside the columns of ``df``, but for those in
    ``drop``, and read for the cells and for the result.
    """
    t, n, s, g, p, d, x = free_name(
        df, "__text", "__tokens", "__source", "__lang", "__topic", "__draw", "__probability"
    )
    keyed = df.withColumn(t, text_of()).withColumn(n, n_tokens_of(F.col(t)))
    given = [c for c in df.columns if c not in (*ADDED, *drop)]
    keyed = keyed.select(
        *[F.col(c) for c in given],
        F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias(s),
        F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias(g),
        topic_of(F.col(t), F.col(n)).alias(p),
        n,
        draw(F.coalesce(F.col("doc_id").cast("string"), F.col(t))).alias(d),
    )
    keyed = staging.table(keyed, "keyed")
    rows = keyed.select(F.col(s).alias("source"), F.col(g).alias("lang"), F.col(p).alias("topic"), F.col(n).alias("tokens"))
    cells = raked_cells(rows, staging, targets=targets, sweeps=sweeps)
    cells = staging.table(
        cells.select(F.col("source").alias(s), F.col("lang").alias(g), F.col("topic").alias(p), "probability"), "mix"
    ).withColumnRenamed("probability", x)
    # A row without a token weighs nothing, even where others of its cell do.
    chance = F.when(F.col(n) > 0, F.coalesce(x, F.lit(0.0))).otherwise(0.0)
    return keyed.join(cells, [s, g, p], "left").select(
        *[F.col(c) for c in given],
        F.col(p).alias("topic"),
        F.col(n).alias("n_tokens"),
        chance.alias("probability"),
        (F.col(d) < chance).alias("sampled"),
    )


def mix_sql(table: str = "documents", sweeps: int = SWEEPS) -> str:
    """DuckDB SQL of :func:`mix_documents` with tempered targets."""
    share = lambda cs: f"length(t) - length(translate(t, '{cs}', ''))"
    calibrated = "".join(
        f""", c{r + 1} AS (
    SELECT ({KEEP} * sum(tokens) - sum(CASE WHEN capped THEN tokens ELSE 0 END))
           / sum(CASE WHEN capped THEN 0 ELSE weight END) AS c
    FROM (SELECT tokens, weight, weight / tokens * (SELECT c FROM c{r}) >= 1 AS capped FROM raked)
)"""
        for r in range(ROUNDS)
    )
    steps, last = [], "cells"
    for sweep in range(sweeps):
        for m in MARGINS:
            name = f"{m}_{sweep}"
            steps.append(
                f"{name} AS (SELECT source, lang, topic, tokens, weight * target"
                f" * (SELECT sum(tokens) FROM cells) / sum(weight) OVER (PARTITION BY {m}) AS weight"
                f" FROM {last} JOIN target_{m} USING ({m}))"
            )
            last = name
    targets = ", ".join(
        f"target_{m} AS (SELECT {m}, pow(sum(tokens), {TEMPER}) / sum(pow(sum(tokens), {TEMPER})) OVER () AS target"
        f" FROM cells GROUP BY {m})"
        for m in MARGINS
    )
    return f"""
WITH texts AS (
    SELECT *, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
    FROM {table}
), docs AS (
    SELECT doc_id, t, n_tokens, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
           CASE WHEN 10 * ({share("0123456789")}) > length(t) THEN 'numbers'
                WHEN 10 * ({share(SYMBOLS)}) > length(t) THEN 'symbols'
                WHEN 3 * ({share(LETTERS.upper())}) > length(t) THEN 'capitals'
                WHEN n_tokens < 100 THEN 'short' WHEN n_tokens < 1000 THEN 'medium' ELSE 'long' END AS topic
    FROM texts
), cells AS (
    SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE AS weight
    FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0
), {targets}, {", ".join(steps)}, raked AS (
    SELECT * FROM {last}
), c0 AS (
    SELECT 0.0::DOUBLE AS c
){calibrated}, scaled AS (
    SELECT source, lang, topic, least(1, weight / tokens * (SELECT c FROM c{ROUNDS})) AS p FROM raked
), chances AS (
    SELECT doc_id, t, source, lang, topic, n_tokens, CASE WHEN n_tokens > 0 THEN coalesce(p, 0) ELSE 0 END AS p
    FROM docs LEFT JOIN scaled USING (source, lang, topic)
)
SELECT doc_id, topic, n_tokens, round(p, 6) AS probability,
       ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, t)), 1, 8))::BIGINT / 4294967296.0 < p AS sampled
FROM chances
"""

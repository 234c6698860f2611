"""Quality rules in built-in functions: counts, and distance from the language.

Two histograms of a document are compared with those of its language by the
Jensen-Shannon distance: character classes, and the language's common words
against all other words. The references are summed over all documents of the
language that are long enough to judge. A distance tells chance from junk only in
a text long enough, so texts of fewer than ``MIN_WORDS`` words are not judged,
and the allowed distance has a part that falls with the root of the length, as
the noise of a sample does.

Null texts have no words; a null language, or one without a word list, is
compared by character classes with all such documents. Rows are judged one by
one, so repeated rows and ties get the same verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.llm.common import SPACES, free_name, text_of

WINDOW = 5
MIN_WORDS = 30
#: Allowed distance: the first number, and the second over the root of the number of words.
CHAR_LIMIT = (0.16, 1.0)
WORD_LIMIT = (0.22, 1.2)

# The commonest function words of each language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als".split(),
    "en": "the of and to a in is that it for was on with as be by this are at from".split(),
    "es": "de la que el en y los se del las un por con no su una para es al lo".split(),
    "fr": "de la le et les des en un du une que pour est par qui dans avec sur pas au".split(),
}
BINS = max(map(len, COMMON_WORDS.values()))

# Character classes besides white space; all other characters, lower-case
# letters above all, are one class.
SYMBOLS = "#*$%&|<>"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
CLASSES = {
    "upper": "[A-Z]",
    "digit": "[0-9]",
    "symbol": "[#*$%&|<>]",
    "punctuation": "[-.,;:!?'\"()]",
}
N_CLASSES = len(CLASSES) + 2
#: What words are cut at before they are looked up.
CUTS = r"[\x20\x09-\x0D.,;:!?\"()]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACES}+"), "")


def _language(lang: str | None) -> Column:
    """The language if it has a word list, else empty: a short list of keys, whatever the data."""
    if lang is None:
        return F.lit("")
    return F.when(F.col(lang).isin(*COMMON_WORDS), F.col(lang)).otherwise("")


def _counts(df: DataFrame, text: str, lang: str | None, kept: list[str], full: bool) -> tuple[DataFrame, dict[str, str]]:
    """The ``kept`` columns, the language and both histograms, under free names.

    ``full``: with the hashes of the words and the number of repeated lines as
    well. What a later step reads more than once, or in a lambda, is a column of
    its own, so that it is worked out once per row; each step carries on only
    what is needed yet, as it copies its rows.
    """
    plain = "text language words own tokens codes counts letters chars common n n_tokens size hashes dup_lines".split()
    names = dict(zip(plain, free_name(df, *[f"__{x}" for x in plain])))
    col = {k: F.col(name) for k, name in names.items()}
    lists = F.create_map(
        *[x for k, ws in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, ws)))],
        F.lit(""),
        F.array(F.lit("")),
    )
    known = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    t = col["text"]
    df = df.select(*kept, text_of(text).alias(names["text"]), _language(lang).alias(names["language"]))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(SPACES.replace("[", "[^", 1)))
    df = df.select(
        *kept,
        t,
        col["language"],
        _words(t).alias(names["words"]),
        lists[col["language"]].alias(names["own"]),
        F.array_remove(F.split(F.lower(t), CUTS), "").alias(names["tokens"]),
        *([lines.alias(names["dup_lines"])] if full else []),
    )
    # Words in no list leave first, by a hash lookup; the rest become their place in the list.
    codes = F.transform(
        F.filter(col["tokens"], lambda w: w.isin(*known)), lambda w: F.array_position(col["own"], w).cast("int")
    )
    dup = F.size(col["dup_lines"]) - F.size(F.array_distinct(col["dup_lines"]))
    more = [F.transform(col["words"], lambda w: F.xxhash64(w)).alias(names["hashes"]), dup.alias(names["dup_lines"])]
    df = df.select(
        *kept,
        col["language"],
        codes.alias(names["codes"]),
        F.size(col["words"]).alias(names["n"]),
        F.size(col["tokens"]).alias(names["n_tokens"]),
        F.length(t).alias(names["size"]),
        F.length(F.array_join(col["words"], "")).alias(names["letters"]),
        F.array(*[F.regexp_count(t, F.lit(c)) for c in CLASSES.values()]).alias(names["counts"]),
        *(more if full else []),
    )
    c, counts = col["codes"], col["counts"]
    found = [F.size(c) - F.size(F.array_remove(c, i + 1)) for i in range(BINS)]
    passed = [col[k] for k in ("language", "n", "n_tokens", "size", "letters", "counts")]
    passed += [col["hashes"], col["dup_lines"]] if full else []
    df = df.select(*kept, *passed, F.array(*found).alias(names["common"]))
    rest = col["letters"] - sum((counts[i] for i in range(len(CLASSES))), F.lit(0))
    others = col["n_tokens"] - sum((col["common"][i] for i in range(BINS)), F.lit(0))
    blank = col["size"] - col["letters"]
    df = df.select(
        *kept,
        *passed,
        F.concat(counts, F.array(blank, rest)).cast("array<double>").alias(names["chars"]),
        F.concat(col["common"], F.array(others)).cast("array<double>").alias(names["common"]),
    )
    return df, names


def language_references(df: DataFrame, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """``language`` with the summed ``chars`` and ``common`` of its documents of ``MIN_WORDS`` words or more.

    At most one row per language that has a word list, and one for all others.
    """
    counted, names = _counts(df, text, lang, [], full=False)
    sizes = {"chars": N_CLASSES, "common": BINS + 1}
    sums = [
        F.sum(F.col(names[kind])[i]).alias(f"{kind}{i}") for kind, n in sizes.items() for i in range(n)
    ]
    summed = (
        counted.filter(F.col(names["n"]) >= MIN_WORDS)
        .groupBy(F.col(names["language"]).alias("language"))
        .agg(*sums)
    )
    return summed.select(
        "language", *[F.array(*[f"{kind}{i}" for i in range(n)]).alias(kind) for kind, n in sizes.items()]
    )


def _total(histogram: Column) -> Column:
    return F.aggregate(histogram, F.lit(0.0), lambda a, x: a + x)


def js_distance(p: Column, q: Column, p_total: Column, q_total: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms given with their sums; 0 to 1."""

    def part(x: Column, y: Column) -> Column:
        a, b = x / p_total, y / q_total
        low, high = F.lit(0.0), (a + b) / 2
        return F.when(a > 0, a * F.log2(a / high)).otherwise(low) + F.when(
            b > 0, b * F.log2(b / high)
        ).otherwise(low)

    divergence = _total(F.zip_with(p, q, part)) / 2
    return F.when((p_total > 0) & (q_total > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def _repeats(df: DataFrame, hashes: str) -> tuple[DataFrame, Column]:
    """The number of words in windows of five that the text has twice or more.

    Windows are compared by 64-bit hashes, sorted with their places; of the
    places of equal neighbours each covers five words or up to the next place.
    """
    kept = [c for c in df.columns if c != hashes]
    pairs, fours, windows, order = free_name(df, "__pairs", "__fours", "__windows", "__order")
    win, o, n = F.col(windows), F.col(order), F.size(hashes) - WINDOW + 1

    def joined(left: str, right: str, by: int, size: Column) -> Column:
        """Hashes of each element of one array with that ``by`` places on in another."""
        return F.when(
            n > 1,
            F.zip_with(
                F.slice(left, F.lit(1), size), F.slice(right, F.lit(by + 1), size), lambda a, b: F.xxhash64(a, b)
            ),
        )

    # Windows of two words, of four, and of five.
    df = df.select(*kept, hashes, joined(hashes, hashes, 1, n + 3).alias(pairs))
    df = df.select(*kept, hashes, joined(pairs, pairs, 2, n + 1).alias(fours))
    df = df.select(*kept, joined(fours, hashes, 4, n).alias(windows))
    places = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.select(*kept, F.when(F.size(F.array_distinct(win)) < F.size(win), places).alias(order))
    m = F.size(o) - 1
    equal = F.zip_with(
        F.slice(o, F.lit(1), m), F.slice(o, F.lit(2), m), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))
    )
    found = F.sort_array(F.array_distinct(F.flatten(F.array_compact(equal))))
    df = df.select(*kept, F.when(o.isNotNull(), found).alias(windows))
    k = F.size(win) - 1
    gaps = F.zip_with(
        F.slice(win, F.lit(1), k), F.slice(win, F.lit(2), k), lambda x, y: F.least(F.lit(WINDOW), y - x)
    )
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda a, x: a + x)
    return df, F.when(win.isNotNull(), covered).otherwise(0).cast("long")


#: Columns that are added.
ADDED = tuple(
    "n_words word_chars n_symbols n_dup_lines n_repeat_words char_distance word_distance base_failed kept".split()
)


def judge_documents(df: DataFrame, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """``df`` with the counts, both distances, ``base_failed`` and ``kept``.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``char_distance``, ``word_distance``: distances are null where there is nothing
    to compare. Columns of those names are replaced, others pass through.

    Two passes over the texts: one sums the references, whose few rows are
    broadcast, and one judges. No text is shuffled.
    """
    kept = [c for c in df.columns if c not in ADDED]
    of, chars_of, common_of = free_name(df, "__of", "__chars_of", "__common_of")
    references = language_references(df, text, lang).withColumnsRenamed(
        {"language": of, "chars": chars_of, "common": common_of}
    )
    counted, names = _counts(df, text, lang, kept, full=True)
    counted, repeats = _repeats(counted, names["hashes"])
    symbols = F.col(names["counts"])[list(CLASSES).index("symbol")]
    # Generated columns: Spark moves no filter on them below, where the steps
    # they are made in would be worked out again for each time they are named.
    counted = counted.select(
        *kept,
        names["language"],
        F.inline(
            F.array(
                F.struct(
                    F.col(names["n"]).cast("long").alias("n_words"),
                    F.col(names["letters"]).cast("long").alias("word_chars"),
                    symbols.cast("long").alias("n_symbols"),
                    F.col(names["dup_lines"]).cast("long").alias("n_dup_lines"),
                    repeats.alias("n_repeat_words"),
                    F.col(names["chars"]),
                    F.col(names["common"]),
                    F.col(names["size"]).cast("double").alias(names["size"]),
                    F.col(names["n_tokens"]).cast("double").alias(names["n_tokens"]),
                )
            )
        ),
    )
    joined = counted.join(
        F.broadcast(references), counted[names["language"]] == references[of], "left"
    )

    def distance(own: str, other: str, total: str) -> Column:
        return js_distance(F.col(names[own]), F.col(other), F.col(names[total]), _total(F.col(other)))

    result = joined.select(
        *kept,
        *ADDED[:5],
        distance("chars", chars_of, "size").alias("char_distance"),
        F.when(F.col(names["language"]) != "", distance("common", common_of, "n_tokens")).alias("word_distance"),
    )
    n = F.col("n_words")
    failed = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    noise = F.sqrt(F.greatest(n, F.lit(1)).cast("double"))
    far = F.coalesce(F.col("char_distance") > CHAR_LIMIT[0] + CHAR_LIMIT[1] / noise, F.lit(False)) | F.coalesce(
        F.col("word_distance") > WORD_LIMIT[0] + WORD_LIMIT[1] / noise, F.lit(False)
    )
    return result.withColumns({"base_failed": failed, "kept": ~failed & ~((n >= MIN_WORDS) & far)})


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def judge_sql(table: str = "documents", key: str = "row_number() OVER ()") -> str:
    """DuckDB SQL of the same verdicts: ``n`` (the key) and every column but the distances."""
    parts = [
        "len(regexp_extract_all(t, '{}'))::DOUBLE".format(c.replace("'", "''")) for c in CLASSES.values()
    ] + ["(length(t) - length(array_to_string(ws, '')))::DOUBLE"]
    lists = " ".join(f"WHEN '{k}' THEN {_sql_list(ws)}" for k, ws in COMMON_WORDS.items())
    js = """sqrt(greatest(0, list_sum(list_transform(range(1, len(p) + 1), lambda i:
        (CASE WHEN p[i] > 0 THEN p[i] * log2(2 * p[i] / (p[i] + q[i])) ELSE 0 END)
      + (CASE WHEN q[i] > 0 THEN q[i] * log2(2 * q[i] / (p[i] + q[i])) ELSE 0 END))) / 2))"""
    share = lambda h: f"list_transform({h}, lambda x: x / list_sum({h}))"
    sums = lambda kind, n: "[" + ", ".join(f"sum({kind}[{i}])" for i in range(1, n + 1)) + "]"
    return f"""
WITH texts AS (
    SELECT *, {key} AS n, coalesce(text, '') AS t FROM {table}
), worded AS (
    SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
           CASE WHEN lang IN ({", ".join(f"'{k}'" for k in COMMON_WORDS)}) THEN lang ELSE '' END AS own
    FROM texts
), looked AS (
    SELECT *, list_filter(string_split_regex(lower(t), '{CUTS}'), lambda w: w <> '') AS plain,
           CASE own {lists} ELSE [] END AS common
    FROM worded
), hists AS (
    SELECT * EXCLUDE (plain), len(plain) AS tokens, [{", ".join(parts)}] AS c0,
           list_transform(range(1, {BINS + 1}), lambda i: len(list_filter(plain, lambda w: w = common[i]))::DOUBLE) AS w0
    FROM looked
), full_hists AS (
    SELECT *, list_append(c0, length(t) - list_sum(c0)) AS c, list_append(w0, tokens - list_sum(w0)) AS w FROM hists
), refs AS (
    SELECT own, {sums("c", N_CLASSES)} AS rc, {sums("w", BINS + 1)} AS rw
    FROM full_hists WHERE len(ws) >= {MIN_WORDS} GROUP BY own
), windows AS (
    SELECT n, i, ws[i:i + {WINDOW - 1}] AS win
    FROM (SELECT n, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM worded)
), again AS (
    SELECT n, i FROM windows QUALIFY count(*) OVER (PARTITION BY n, win) > 1
), covered AS (
    SELECT n, count(DISTINCT i + o) AS n_repeat_words
    FROM again, (SELECT unnest(range({WINDOW})) AS o) GROUP BY n
), lined AS (
    SELECT n, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM texts
), counted AS (
    SELECT f.*, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
           c0[{list(CLASSES).index("symbol") + 1}]::BIGINT AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words, rc, rw
    FROM full_hists f JOIN lined USING (n) LEFT JOIN covered USING (n) LEFT JOIN refs r ON r.own = f.own
), far AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           CASE WHEN length(t) > 0 AND list_sum(rc) > 0
                THEN (SELECT {js} FROM (SELECT {share("c")} AS p, {share("rc")} AS q)) END AS cd,
           CASE WHEN own <> '' AND tokens > 0 AND list_sum(rw) > 0
                THEN (SELECT {js} FROM (SELECT {share("w")} AS p, {share("rw")} AS q)) END AS wd
    FROM counted
)
SELECT * EXCLUDE (t, ws, own, common, c0, w0, c, w, tokens, rc, rw, cd, wd),
       NOT base_failed AND NOT (n_words >= {MIN_WORDS} AND (
           coalesce(cd > {CHAR_LIMIT[0]} + {CHAR_LIMIT[1]} / sqrt(n_words), false)
           OR coalesce(wd > {WORD_LIMIT[0]} + {WORD_LIMIT[1]} / sqrt(n_words), false))) AS kept
FROM far
"""

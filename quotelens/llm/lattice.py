"""Marginal likelihood of documents over all segmentations into subwords.

The pieces and their first scores come from an existing vocabulary file. A
document is a run of words, each led by a blank, and an end; a word is spelled by
pieces in many ways, and its probability is the sum over all of them, worked out
from left to right in log space over the lattice of pieces. Single bytes are
pieces too, so every text has a probability. As no piece has a blank inside, the
probability of a document is the product of those of its words and of the end.

The words of the training texts are pieces as well: one arc over the whole word,
weighed by its count less a discount ``D``. What the discounts free goes to the
lattice of the vocabulary's pieces, which so spells new words above all:

    P(word) = (1 - P(end)) * (max(count - D, 0) / N + D * V / N * P(spelled))

The language of a document is hidden as well: each of the ``LANGUAGES`` commonest
of the training texts has word counts of its own, which back off to those of all
texts as these do to spelling, and a document's probability is the sum over
languages, weighed by their shares.

Piece probabilities are re-estimated from all distinct training words by
expectation maximization: each pass weighs every segmentation of every word by
the present scores and sums the expected piece counts. What a pass gathers is
one number per piece; what the corpus gives is its distinct words with their
counts, combined in the map tasks and summed by word.

Scores meet the documents in two tiers. The most frequent words are a compact
broadcast table; what a document has besides them is joined by word hash, where
no key is hot any more. Words are compared by 64-bit hashes.

Null and empty texts are an end and no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.llm.common import (
    HashTable,
    Words,
    buffers,
    gathered,
    most_frequent,
    power_tables,
    text_of,
    words_in,
)
from quotelens.sources.staging import Staging

VOCABULARY = "piece_bpe_32k.model"
#: Passes of expectation maximization over the training words.
PASSES = 2
#: Added to the expected count of each piece, and of each single byte.
PRIOR, BYTE_PRIOR = 0.01, 1.0
#: Pieces of the common model that each language's counts are filled up with.
SHARED = 100.0
#: Words in the broadcast table, 24 bytes each.
TABLE_ENTRIES = 1 << 16
#: Languages with counts of their own; all others share one more set.
LANGUAGES = 7
#: Longer words are spelled one by one; shorter ones together with all of their length.
TOGETHER_BYTES = 64
ROWS_AT_ONCE, CELLS_AT_ONCE = 1 << 16, 1 << 20

_U = np.uint64


@dataclass
class Vocabulary:
    """Distinct byte strings, a blank for the word boundary, and their log probabilities."""

    pieces: list[bytes]
    scores: np.ndarray

    def __post_init__(self):
        self.longest = max(map(len, self.pieces))
        words = Words(*_joined(self.pieces))
        self.table = HashTable(_raw_hashes(words.data, words.starts, words.ends), np.arange(len(self.pieces)), -1)


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(parts), np.uint8), ends - sizes, ends, np.array([0, len(parts)])


def _running(codes: np.ndarray) -> np.ndarray:
    """Running sums of the bytes times powers of the hash base, along the last axis."""
    up, _ = power_tables(codes.shape[-1] + 1)
    sums = np.zeros((*codes.shape[:-1], codes.shape[-1] + 1), _U)
    np.cumsum((codes.astype(_U) + _U(1)) * up[: codes.shape[-1]], axis=-1, out=sums[..., 1:])
    return sums


def _raw_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums, down = _running(data), power_tables(len(data) + 1)[1]
    return (sums[ends] - sums[starts]) * down[starts]


@lru_cache(2)
def load(path: str) -> Vocabulary:
    """Pieces of a sentencepiece file and their first scores.

    Scores of a unigram model are log probabilities. Those of a merge list are
    minus the rank; a piece of rank r then starts in proportion to 1 / (r + 2).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {bytes([b]): -12.0 for b in range(256)}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or b" " in piece[1:]:
            continue
        score = model.get_score(i)
        found[piece] = max(found.get(piece, -99.0), score if score > -30 and score % 1 else -np.log(2.0 - score))
    scores = np.array(list(found.values()))
    return Vocabulary(list(found), scores - np.log(np.exp(scores).sum()))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)


class Lattice:
    """Probabilities of words under piece scores, and expected piece counts.

    ``scores``: a row per piece, a column per model.
    """

    def __init__(self, vocabulary: Vocabulary, scores: np.ndarray):
        self.vocabulary, self.scores = vocabulary, scores

    def words(self, words: list[bytes], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The log probability of each word in each model.

        With ``weights``, a row per word, also the piece counts the first model
        expects, summed over words by each column of weights.
        """
        out = np.empty((len(words), self.scores.shape[1]))
        counts = np.zeros((len(self.scores), 0 if weights is None else weights.shape[1]))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            if size > TOGETHER_BYTES:
                for i in rows:
                    codes = np.frombuffer(b" " + words[i], np.uint8)
                    out[i] = self._long(codes, None if weights is None else weights[i], counts)
                continue
            step = max(1, CELLS_AT_ONCE // int(size))
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                codes = np.frombuffer(b"".join(b" " + words[i] for i in some), np.uint8).reshape(len(some), size)
                out[some] = self._together(codes, None if weights is None else weights[some], counts)
        return out, counts

    def _together(self, codes: np.ndarray, weights: np.ndarray | None, counts: np.ndarray) -> np.ndarray:
        """Words of one length: every step of the recursion is taken for all of them."""
        n, size = codes.shape
        sums, down = _running(codes), power_tables(size + 1)[1]
        forward = np.full((size + 1, n, self.scores.shape[1]), -np.inf)
        forward[0] = 0
        edges = []
        for end in range(1, size + 1):
            for start in range(max(0, end - self.vocabulary.longest), end):
                ids = self.vocabulary.table.get((sums[:, end] - sums[:, start]) * down[start])
                rows = np.flatnonzero(ids >= 0)
                if len(rows):
                    ids = ids[rows]
                    forward[end, rows] = np.logaddexp(forward[end, rows], forward[start, rows] + self.scores[ids])
                    if weights is not None:
                        edges.append((start, end, rows, ids))
        total = forward[size].copy()
        if weights is not None and edges:
            backward = np.full((size + 1, n), -np.inf)
            backward[size] = 0
            shares = []
            for start, end, rows, ids in sorted(edges, key=lambda e: -e[0]):
                via = self.scores[ids, 0] + backward[end, rows]
                backward[start, rows] = np.logaddexp(backward[start, rows], via)
                shares.append((ids, rows, np.exp(forward[start, rows, 0] + via - total[rows, 0])))
            ids, rows, share = (np.concatenate(x) for x in zip(*shares))
            for k in range(weights.shape[1]):
                counts[:, k] += np.bincount(ids, share * weights[rows, k], len(counts))
        return total

    def _long(self, codes: np.ndarray, weight: np.ndarray | None, counts: np.ndarray) -> np.ndarray:
        """One long word: pieces of each length are found at all places, then places follow each other."""
        size = len(codes)
        sums, down = _running(codes), power_tables(size + 1)[1]
        by_end: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
        for length in range(1, min(size, self.vocabulary.longest) + 1):
            ids = self.vocabulary.table.get((sums[length:] - sums[:-length]) * down[: size + 1 - length])
            for start in np.flatnonzero(ids >= 0).tolist():
                by_end[start + length].append((start, int(ids[start])))
        forward = np.zeros((size + 1, self.scores.shape[1]))
        for end in range(1, size + 1):
            forward[end] = np.logaddexp.reduce([forward[s] + self.scores[i] for s, i in by_end[end]])
        if weight is not None:
            backward = np.full(size + 1, -np.inf)
            backward[size] = 0
            for end in range(size, 0, -1):
                for s, i in by_end[end]:
                    via = self.scores[i, 0] + backward[end]
                    backward[s] = np.logaddexp(backward[s], via)
                    counts[i] += weight * np.exp(forward[s, 0] + via - forward[size, 0])
        return forward[size]


def held_out_of(doc_id: Column) -> Column:
    """CRC-32 of the id as text, modulo 7, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _lowered(texts: pa.Array) -> Words:
    data, at = buffers(texts)
    return words_in(lower_ascii(data), at)


def word_counts(df: DataFrame, languages: int) -> DataFrame:
    """``word``, its ``hash``, and how often training texts of each language have it, for every word of every text.

    ``df``: ``text``, ``held_out`` and ``language``, a number below ``languages``.
    Counts are ``n0``, ``n1`` and so on. Words are counted by batch before they are
    shuffled, so a word of a third of all tokens is a row per batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, ROWS_AT_ONCE >> 4):
            words = _lowered(table.column(0))
            training = ~table.column(1).to_numpy().astype(bool)
            keys, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
            language, owner = table.column(2).to_numpy(), words.texts()
            at = which * languages + language[owner]
            n = np.bincount(at, training[owner], len(keys) * languages).astype(np.int64).reshape(-1, languages)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([words.bytes_at(i) for i in first], pa.binary()),
                    pa.array(keys.view(np.int64)),
                    *[pa.array(n[:, k]) for k in range(languages)],
                ],
                names=["word", "hash", *names],
            )

    names = [f"n{k}" for k in range(languages)]
    schema = "word binary, hash long, " + ", ".join(f"{n} long" for n in names)
    parts = df.select("text", "held_out", "language").mapInArrow(run, schema)
    return parts.groupBy("hash").agg(F.any_value("word").alias("word"), *[F.sum(n).alias(n) for n in names])


@dataclass
class Counts:
    """What is needed of a set of word counts: their sum, the discount, and what it frees."""

    tokens: int
    discount: float
    escape: float

    def log_probability(self, n: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Log probability of words seen ``n`` times, of which ``rest`` is that of the model to back off to."""
        with np.errstate(divide="ignore"):
            own = np.log(np.maximum(n - self.discount, 0) / max(self.tokens, 1))
        return np.logaddexp(own, np.log(self.escape) + rest)


def counts_of(tokens: int, kinds: int, once: int, twice: int) -> Counts:
    """The discount is that of Ney, from the numbers of words seen once and twice."""
    if not tokens:
        return Counts(0, 0.0, 1.0)
    discount = min(0.95, max(0.05, once / max(once + 2 * twice, 1)))
    return Counts(tokens, discount, discount * kinds / tokens)


@dataclass
class Model:
    """Piece log probabilities by language, counts of all texts and of each language, and the end's probability."""

    scores: np.ndarray
    whole: Counts
    languages: list[Counts]
    end: float

    def word_probability(self, n: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Log10 probability in each language, a row a word, of words of ``n`` training occurrences in each.

        ``spelled``: their log spelling probability. Spelling begins with one of
        the pieces that lead a word, and goes on until the next piece would be one
        of these: their common probability divides the first piece and multiplies
        the end, so it cancels out and what is spelled adds up to one over all words.
        """
        found = [
            c.log_probability(n[:, k], self.whole.log_probability(n.sum(1), spelled[:, k]))
            for k, c in enumerate(self.languages)
        ]
        return (np.stack(found, 1) + np.log1p(-self.end)) / np.log(10)


def train(counts: DataFrame, path: str, documents: int, languages: int, passes: int = PASSES) -> Model:
    """A model of the words of :func:`word_counts` in so many documents; all of them in every pass.

    A task sends one number per piece, which are summed per piece; the vocabulary
    bounds what reaches the driver.
    """
    ns = [F.col(f"n{k}") for k in range(languages)]
    every = sum(ns[1:], ns[0])
    context = counts.sparkSession.sparkContext
    vocabulary = load(path)
    prior = np.array([BYTE_PRIOR if len(p) == 1 else PRIOR for p in vocabulary.pieces])
    scores = vocabulary.scores[:, None]
    for left in range(passes, 0, -1):
        # All texts together, and in the last pass each language by itself as well.
        shared = context.broadcast(scores)
        sets = 1 + languages * (left == 1)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared, sets=sets) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(load(path), shared.value)
            total = np.zeros((len(shared.value), sets))
            for table in gathered(batches, ROWS_AT_ONCE):
                seen = [np.ones(table.num_rows)] + [table.column(1 + k).to_numpy() > 0 for k in range(sets - 1)]
                total += lattice.words(table.column(0).to_pylist(), np.stack(seen, 1).astype(np.float64))[1]
            piece, kind = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece.astype(np.int32)), pa.array(kind.astype(np.int32)), pa.array(total[piece, kind])],
                names=["piece", "kind", "n"],
            )

        parts = counts.filter(every > 0).select("word", *ns).mapInArrow(expect, "piece int, kind int, n double")
        expected = np.zeros((len(prior), sets))
        for r in parts.groupBy("piece", "kind").agg(F.sum("n").alias("n")).collect():
            expected[r.piece, r.kind] += r.n
        common = expected[:, 0] + prior
        common /= common.sum()
        scores = np.log(common)[:, None]
    # A language has what its words give, and a little of all.
    own = expected[:, 1:] + SHARED * common[:, None]
    scores = np.log(own / own.sum(0))
    forms = [
        x
        for n in (every, *ns)
        for x in (F.coalesce(F.sum(n), F.lit(0)), F.count_if(n > 0), F.count_if(n == 1), F.count_if(n == 2))
    ]
    seen = [int(x) for x in counts.agg(*[x.alias(f"x{i}") for i, x in enumerate(forms)]).first()]
    whole, *each = [counts_of(*seen[i : i + 4]) for i in range(0, len(seen), 4)]
    return Model(scores, whole, each, (documents + 1) / (whole.tokens + documents + 2))


def _scored_words(counts: DataFrame, path: str, model: Model) -> DataFrame:
    """``hash``, ``n`` over all languages, and the log10 probabilities ``p0``, ``p1``... of every distinct word."""
    shared = counts.sparkSession.sparkContext.broadcast(model)
    languages = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = load(path), shared.value
        lattice = Lattice(vocabulary, model.scores)
        for table in gathered(batches, ROWS_AT_ONCE):
            spelled, _ = lattice.words(table.column(1).to_pylist())
            n = np.stack([table.column(2 + k).to_numpy() for k in range(languages)], 1)
            p = model.word_probability(n, spelled)
            yield pa.RecordBatch.from_arrays(
                [table.column(0).combine_chunks(), pa.array(n.sum(1)), *[pa.array(p[:, k]) for k in range(languages)]],
                names=["hash", "n", *names],
            )

    names = [f"p{k}" for k in range(languages)]
    schema = "hash long, n long, " + ", ".join(f"{p} double" for p in names)
    return counts.select("hash", "word", *[f"n{k}" for k in range(languages)]).mapInArrow(run, schema)


def _matched(df: DataFrame, scored: DataFrame, languages: int, entries: int) -> DataFrame:
    """Per row of ``df`` its sums over frequent words, and a row for each other word it has.

    ``row``, ``doc_id``, ``held_out``, ``hash`` and ``n``; the first row of a text has
    its own hash for ``hash``, a null ``n``, and the sums ``n_tokens``, ``n_known``,
    ``base`` (of log10 of the count plus one) and one score per language.
    """
    top = most_frequent(scored, "n", entries).collect()
    keys = np.array([r.hash for r in top], np.int64).view(_U)
    order = np.argsort(keys)
    given = ["n", *[f"p{k}" for k in range(languages)]]
    columns = [np.array([r[c] for r in top])[order] if top else np.zeros(0) for c in given]
    shared = df.sparkSession.sparkContext.broadcast((keys[order], *columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, *p = shared.value
        known, base = (n > 0).astype(np.int64), np.log10(n + 1.0)
        for batch in batches:
            words = _lowered(batch.column(3))
            h, owner, rows = words.hashes(), words.texts(), batch.num_rows
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            sums = [np.bincount(owner[hit], x[at[hit]], rows) for x in (known, base, *p)]
            # The other words of each text, once each, with their number.
            rest, text = h[~hit], owner[~hit]
            by = np.lexsort((rest, text))
            rest, text = rest[by], text[by]
            new = np.ones(len(rest), bool)
            new[1:] = (rest[1:] != rest[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(new)
            often = np.diff(np.append(first, len(rest)))
            who = np.concatenate([np.arange(rows), text[first]])
            key = np.concatenate([batch.column(0).to_numpy().view(_U), rest[first]])
            pad = np.zeros(len(first))
            values = [np.concatenate([x, pad]) for x in (words.counts(), *sums)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i).take(pa.array(who)) for i in (0, 1, 2)],
                    pa.array(key.view(np.int64)),
                    pa.array(np.concatenate([np.full(rows, -1), often]).astype(np.int64)),
                    pa.array(values[0].astype(np.int64)),
                    pa.array(values[1].astype(np.int64)),
                    *map(pa.array, values[2:]),
                ],
                names=names,
            )

    schema = df.select("row", "doc_id", "held_out").schema
    for name, kind in (("hash", "long"), ("times", "long"), ("n_tokens", "long"), ("n_known", "long"), ("base", "double"), *[(f"score{k}", "double") for k in range(languages)]):
        schema = schema.add(name, kind)
    names = schema.names
    return df.select("row", "doc_id", "held_out", "text").mapInArrow(run, schema)


def score_documents(
    df: DataFrame, path: str, staging: Staging, passes: int = PASSES, entries: int = TABLE_ENTRIES
) -> DataFrame:
    """Score every document, with a model of the training documents.

    ``df``: ``doc_id``, ``text`` and, if there, ``lang``, which only training texts are asked for.

    Returns ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (add-one words) and ``score`` (log10 of the text's probability).
    Repeated rows are scored each. The tokens of a text are its words, A to Z in
    lower case, and an end.
    """
    lang = F.col("lang").cast("string") if "lang" in df.columns else F.lit(None).cast("string")
    docs = df.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        held_out_of(F.col("doc_id")).alias("held_out"),
        text_of().alias("text"),
        lang.alias("lang"),
    )
    # The commonest languages of the training texts, a handful, and how many texts they have.
    shares = docs.filter(~F.col("held_out")).groupBy("lang").agg(F.count("*").alias("n"))
    top = shares.filter("lang is not null").orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    training = shares.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    languages = len(top) + 1
    number = F.lit(0)
    for k, r in enumerate(top, 1):
        number = F.when(F.col("lang") == r.lang, k).otherwise(number)
    docs = docs.withColumn("language", number)
    counts = staging.table(word_counts(docs, languages), "words")
    model = train(counts, path, training, languages, passes)
    total = model.whole.tokens + training
    kinds = counts.filter(" + ".join(f"n{k}" for k in range(languages)) + " > 0").count() + (training > 0)
    scored = staging.table(_scored_words(counts, path, model), "scored")
    matched = _matched(docs, scored, languages, entries).alias("m")
    table = scored.withColumnRenamed("n", "c").alias("s")
    # A text's own row has a hash that spreads it, and a negative number of times.
    own = F.col("times") < 0
    joined = matched.join(table, "hash", "left")

    def both(name: str, word: Column) -> Column:
        return F.sum(F.when(own, F.col(f"m.{name}")).otherwise(F.col("times") * word)).alias(name)

    per_text = joined.groupBy("row").agg(
        F.any_value("doc_id").alias("doc_id"),
        F.any_value("held_out").alias("held_out"),
        F.sum("n_tokens").alias("words"),
        both("n_known", (F.col("c") > 0).cast("long")),
        both("base", F.log10(F.col("c") + 1.0)),
        *[both(f"score{k}", F.col(f"p{k}")) for k in range(languages)],
    )
    tokens = F.col("words") + 1
    end_base = float(np.log10(training + 1.0))
    # Shares of the languages, none of them nothing.
    named = [r.n for r in top]
    prior = np.log10((np.array([training - sum(named), *named]) + 0.5) / (training + 0.5 * languages))
    terms = F.array(*[F.col(f"score{k}") + float(prior[k]) for k in range(languages)])
    most = F.array_max(terms)
    mixed = most + F.log10(F.aggregate(terms, F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - most)))
    return per_text.select(
        "doc_id",
        "held_out",
        tokens.alias("n_tokens"),
        (F.col("n_known") + int(training > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + end_base - tokens * float(np.log10(total + kinds + 1.0))).alias("base_score"),
        (mixed + float(np.log10(model.end))).alias("score"),
    )

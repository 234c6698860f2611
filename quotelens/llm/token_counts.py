"""Token counts by a two-tier lookup in the map tasks; no pre-token is shuffled.

A text is cut at ASCII white space, which the tokenizer drops and never merges
across; what lies between are its pre-tokens here. Tier one is a compact table,
sorted hashes and lengths in numpy, of the most frequent pre-tokens of the
corpus, broadcast to every task. Tier two encodes the few misses of a batch with
the library itself and remembers them in the worker. The counts are those of the
library whatever the table holds; it only decides how fast they come.

The table is made in one pass over all texts. Each map task keeps a bounded
summary of its frequent pre-tokens, and only these summaries meet.

Null and empty texts have no tokens. Other columns are not looked at.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.llm.common import Words, free_name, most_frequent, text_of, words_of
from quotelens.sources.staging import Staging

VOCABULARY = "word_bpe_49k.json"
#: Pre-tokens in the broadcast table (16 bytes each), in a task's summary, and in a worker's cache.
TABLE_ENTRIES = 1 << 16
SUMMARY_ENTRIES = 1 << 13
CACHE_ENTRIES = 500_000
#: A summary forgets its rarest pre-tokens when it holds so many times its size.
SLACK = 8


@lru_cache(2)
def tokenizer(path: str):
    """The library's tokenizer; once per Python process, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def library_counts(path: str, words: list[bytes]) -> np.ndarray:
    """The number of tokens of each pre-token, as the library encodes it."""
    found = tokenizer(path).encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
    return np.fromiter((len(e) for e in found), np.int32, len(words))


def frequent_pretokens(
    df: DataFrame, staging: Staging, text: str = "text", entries: int = TABLE_ENTRIES
) -> list[bytes]:
    """The most frequent pre-tokens, ``entries`` at most, as the summaries of all map tasks have them.

    A summary counts the pre-tokens that a batch holds twice or more, and keeps
    the ``SUMMARY_ENTRIES`` most frequent. Their sums are written, and the rows above a
    count that the table holds reach the driver: ``entries`` at most, from all tasks together.
    """

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            words = words_of(batch.column(0))
            _, first, n = np.unique(words.hashes(), return_index=True, return_counts=True)
            for i, k in zip(first[n > 1], n[n > 1].tolist()):
                seen[words.bytes_at(i)] += k
            if len(seen) > SLACK * SUMMARY_ENTRIES:
                seen = Counter(dict(seen.most_common(SUMMARY_ENTRIES)))
        top = seen.most_common(SUMMARY_ENTRIES)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())],
            names=["word", "n"],
        )

    counts = df.select(text_of(text)).mapInArrow(summarize, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = most_frequent(staging.table(counts, "pretokens"), "n", entries).select("word").collect()
    return sorted(bytes(r.word) for r in rows)


class LengthTable:
    """Sorted hashes of pre-tokens and their numbers of tokens."""

    def __init__(self, words: list[bytes], lengths: np.ndarray):
        data = np.frombuffer(b" ".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[: len(words)].astype(np.int64)
        hashes = Words(data, starts, starts + sizes, np.array([0, len(words)])).hashes()
        order = np.argsort(hashes)
        self.hashes, self.lengths = hashes[order], lengths[order].astype(np.int32)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """The number of tokens of each, -1 for a miss."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.lengths[at], np.int32(-1))


_cache: dict[tuple[str, bytes], int] = {}


def _miss_counts(path: str, words: list[bytes]) -> list[int]:
    """Token counts of pre-tokens that the table lacks, through the worker's cache."""
    new = [w for w in words if (path, w) not in _cache]
    if len(_cache) + len(new) > CACHE_ENTRIES:
        _cache.clear()
        new = words
    _cache.update(zip(((path, w) for w in new), library_counts(path, new).tolist()))
    return [_cache[path, w] for w in words]


def count_tokens(
    df: DataFrame, path: str, staging: Staging, text: str = "text", out: str = "n_tokens", entries: int = TABLE_ENTRIES
) -> DataFrame:
    """``df`` with the number of tokens of each text, in one pass without a shuffle.

    The frequent pre-tokens are counted in a pass before, and their sums staged.

    ``path``: a tokenizer file of the tokenizers library whose pre-tokens end at
    white space. ``out`` replaces a column of that name.
    """
    if not path.endswith(".json"):
        raise ValueError(f"not a file of the tokenizers library: {path}")
    words = frequent_pretokens(df, staging, text, entries)
    table = LengthTable(words, library_counts(path, words))
    shared = df.sparkSession.sparkContext.broadcast(table)
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = shared.value
        for batch in batches:
            words = words_of(batch.column(len(kept)))
            hashes = words.hashes()
            n = lengths.get(hashes).astype(np.int64)
            misses = np.flatnonzero(n < 0)
            _, first, which = np.unique(hashes[misses], return_index=True, return_inverse=True)
            if len(first):
                n[misses] = np.array(
                    _miss_counts(path, [words.bytes_at(i) for i in misses[first]]), np.int64
                )[which]
            sums = np.concatenate([[0], np.cumsum(n)])
            total = sums[words.offsets[1:]] - sums[words.offsets[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(total, pa.int64())], names=[*kept, out]
            )

    schema = df.select(*kept).schema.add(out, "long")
    (source,) = free_name(df, "__text")
    return df.select(*kept, text_of(text).alias(source)).mapInArrow(run, schema)

"""Byte-level BPE over padded numpy matrices.

The distinct pre-tokens of a batch are bucketed by their length in bytes, one row
of a matrix each. Every round, each row merges its leftmost pair of least rank:
the ranks of all neighbouring pairs come from a hash table in numpy, the row's
minimum picks the pair, and the cells behind it move up by one. Rows without a
pair that merges are done and leave the matrix. Pre-tokens of more than
``MATRIX_BYTES`` bytes, whose rounds would cost their length squared, are merged
one by one with a heap, in the same order.

Null and empty texts have no tokens. A text of any length is taken in pieces of
``PIECE_MATCHES`` pre-tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quotelens.llm.common import HashTable, free_name, text_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MATRIX_BYTES = 256
PIECE_MATCHES = 200_000
GROUP_CHARS = 4_000_000
#: Encoded pre-tokens a worker remembers; it starts anew when there are more.
CACHE_ENTRIES = 500_000
#: Cells of a matrix that are merged at once.
MATRIX_CELLS = 1 << 20

NONE = np.int32(2**31 - 1)


class PairTable:
    """Rank of a pair of token ids, by hashed lookup; ``NONE`` where a pair does not merge."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        keys = np.array([(a << 32) | b for a, b in pairs], np.uint64)
        self.table = HashTable(keys, np.fromiter(pairs.values(), np.int32, len(pairs)), NONE)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.table.get((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64))


class Encoder:
    """A vocabulary of byte strings with ranks, and the merges it stands for."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # Any two tokens whose bytes together are a token merge into it.
        self.pairs = {
            (ranks[t[:i]], ranks[t[i:]]): rank
            for t, rank in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        }
        self.table = PairTable(self.pairs)
        self._forget()

    def encode_tokens(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each pre-token."""
        out: list[np.ndarray | None] = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            if size > MATRIX_BYTES:
                for i in rows:
                    out[i] = self._heap(words[i])
                continue
            step = max(1, MATRIX_CELLS // max(int(size), 1))
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                raw = np.frombuffer(b"".join(words[i] for i in some), np.uint8)
                for i, ids in zip(some, self._matrix(self.byte_ids[raw].reshape(len(some), size))):
                    out[i] = ids
        return out

    def _matrix(self, cells: np.ndarray) -> list[np.ndarray]:
        """Merge the rows of a matrix of ids, all of one length, to the end."""
        n, width = cells.shape
        done: list[np.ndarray | None] = [None] * n
        rows, left = np.arange(n), np.full(n, width)
        ranks = self.table.get(cells[:, :-1], cells[:, 1:]) if width > 1 else np.empty((n, 0), np.int32)
        while True:
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            least = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), NONE)
            for i in np.flatnonzero(least == NONE):
                done[rows[i]] = cells[i, : left[i]].copy()
            going = least != NONE
            if not going.any():
                return done
            cells, ranks, rows = cells[going], ranks[going], rows[going]
            left, best, least = left[going] - 1, best[going], least[going]
            at = np.arange(len(rows))
            # A token's rank is its id, so the merged pair becomes the rank itself.
            cells[at, best] = least
            width = int(left.max())
            source = np.arange(width) + (np.arange(width) > best[:, None])
            cells = np.take_along_axis(cells, source, 1)
            if width < 2:
                ranks = np.empty((len(rows), 0), np.int32)
                continue
            gaps = np.arange(width - 1)
            ranks = np.take_along_axis(ranks, gaps + (gaps > best[:, None]), 1)
            ranks[gaps[None, :] >= (left - 1)[:, None]] = NONE
            # Only the pairs on both sides of the merged cell are new.
            some = np.flatnonzero(best > 0)
            ranks[some, best[some] - 1] = self.table.get(
                cells[some, best[some] - 1], cells[some, best[some]]
            )
            some = np.flatnonzero(best < left - 1)
            ranks[some, best[some]] = self.table.get(
                cells[some, best[some]], cells[some, best[some] + 1]
            )

    def _heap(self, word: bytes) -> np.ndarray:
        """The same merges for one long pre-token, in n log n steps."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        get = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], np.int32)

    def _forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.firsts = np.zeros(1, np.int64)

    def _codes(self, words: list[str]) -> np.ndarray:
        """The number of each word in the cache, after encoding those that are new, all at once."""
        codes = list(map(self.cache.get, words))
        if None in codes:
            missing = list(dict.fromkeys(w for w, c in zip(words, codes) if c is None))
            if len(self.cache) + len(missing) > CACHE_ENTRIES:
                self._forget()
                missing = list(dict.fromkeys(words))
            found = self.encode_tokens([w.encode() for w in missing])
            ends = self.firsts[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            self.cache.update(zip(missing, range(len(self.cache), len(self.cache) + len(missing))))
            self.flat = np.concatenate([self.flat, *found])
            self.firsts = np.concatenate([self.firsts, ends])
            codes = list(map(self.cache.__getitem__, words))
        return np.array(codes, np.int64)

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a run of pre-tokens one after the other, and where each one's begin."""
        codes = self._codes(words)
        first, size = self.firsts[codes], np.diff(self.firsts)[codes]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)], ends

    def encode_long(self, text: str) -> np.ndarray:
        matches = (m[0] for m in self.pattern.finditer(text))
        parts = [np.empty(0, np.int32)]
        while words := list(islice(matches, PIECE_MATCHES)):
            parts.append(self._joined(words)[0])
        return np.concatenate(parts)

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, each match of the pattern encoded by itself.

        Texts go in groups of so many characters that their pre-tokens fit in
        memory; one longer than a group is taken in pieces.
        """
        k = 0
        while k < len(texts):
            if len(texts[k]) > GROUP_CHARS:
                yield self.encode_long(texts[k])
                k += 1
                continue
            group, size = [], 0
            while k < len(texts) and size + len(texts[k]) <= GROUP_CHARS:
                group.append(self.pattern.findall(texts[k]))
                size += len(texts[k])
                k += 1
            ids, ends = self._joined(list(chain.from_iterable(group)))
            at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, group), np.int64, len(group)))])
            for i, j in zip(ends[at[:-1]], ends[at[1:]]):
                yield ids[i:j]

    def encode(self, text: str) -> np.ndarray:
        (found,) = self.encode_all([text])
        return found

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def load(path: str, pattern: str) -> Encoder:
    """The encoder of a file of base64 tokens and ranks; once per Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Encoder(ranks, pattern)


def encode_documents(
    df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """``df`` with the token ids of each text, and the bytes they decode to if asked for.

    Row by row: nothing is shuffled and other columns pass through, whatever
    their names; ``ids`` and ``decoded`` replace columns of those names.
    """
    added = {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.BinaryType()} if decoded else {})
    kept = [c for c in df.columns if c not in added]
    (source,) = free_name(df, "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path, pattern)
        for batch in batches:
            found = list(encoder.encode_all(batch.column(len(kept)).to_pylist()))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.concatenate([np.empty(0, np.int32), *found])
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            columns = [*batch.columns[: len(kept)], pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))]
            if decoded:
                columns.append(pa.array([encoder.decode(x.tolist()) for x in found], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *added])

    schema = df.select(*kept).schema
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return df.select(*kept, text_of(text).alias(source)).mapInArrow(run, schema)


def token_digests(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and SHA-256 digests of the ids and of the decoded bytes.

    The ids are digested as little-endian unsigned 32-bit integers. The same
    encoding as :func:`encode_documents`, without carrying the ids out of Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path, pattern)
        for batch in batches:
            sizes, of_ids, of_bytes = [], [], []
            for found in encoder.encode_all(batch.column(1).to_pylist()):
                sizes.append(len(found))
                of_ids.append(hashlib.sha256(found.astype("<u4").tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(encoder.decode(found.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = df.select("doc_id").schema
    for name, kind in (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")):
        schema = schema.add(name, kind)
    return df.select("doc_id", text_of(text).alias("__text")).mapInArrow(run, schema)

"""What the corpus operators share: reading, staging, and words as numpy arrays.

Words are the maximal runs of bytes other than ASCII white space. Every batch of
texts is looked at as one buffer of UTF-8 bytes, so that splitting and hashing
are a handful of numpy calls per batch and no Python string per word exists.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.session import configure
from quotelens.sources.staging import Staging, shared_folder

#: ASCII white space as a Java and DuckDB character class, and its complement.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Texts go to Python in batches of so many rows, if the session doesn't say otherwise.
BATCH_ROWS = 1_024
#: Bloom filters of join keys have 8 MB here, over scans from 1 GB on: Python takes part of an executor's memory.
BLOOM_FILTERS = {
    f"spark.sql.optimizer.runtime.bloomFilter.{name}": value
    for name, value in {
        "applicationSideScanSizeThreshold": "1GB",
        "creationSideThreshold": "64MB",
        "expectedNumItems": "4000000",
        "maxNumItems": "8000000",
        "numBits": "67108864",
        "maxNumBits": "67108864",
    }.items()
}


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the operators count on, where the user set nothing."""
    given = spark.conf.getAll
    for name, value in {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, **BLOOM_FILTERS}.items():
        if name not in given:
            spark.conf.set(name, value)
    return configure(spark)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def staging(spark: SparkSession) -> Staging:
    """Staging in the folder the cluster names; a local session without one gets its own."""
    if shared_folder(spark) is None and spark.sparkContext.master.split("[")[0] == "local":
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quotelens-"))
    return Staging(spark, required=True)


def free_name(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as make it new in ``df``."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def text_of(name: str = "text"):
    """A text column, null taken as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


# --- words in numpy -------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: list[np.ndarray] = []


def power_tables(n: int) -> list[np.ndarray]:
    """Powers of the hash base and of its inverse, of at least ``n`` entries."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, _BLOCK + 1)
        _tables[:] = [_powers(_BASE, size), _powers(_INVERSE, size)]
    return _tables


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are sorted and don't overlap.

    A polynomial over the bytes modulo 2**64, from running sums, then mixed. The
    sums are taken block by block, each ending where a span ends, so that memory
    is that of a block whatever the size of the batch.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        block = data[base : ends[j - 1]]
        up, down = power_tables(len(block) + 1)
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[: len(block)], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


@dataclass
class Words:
    """Words of a batch of texts: their spans in ``data``, and where each text's begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def texts(self) -> np.ndarray:
        """The text each word is of."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def bytes_at(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings, and the offsets of each; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        texts.offset : texts.offset + len(texts) + 1
    ].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words_of(texts: pa.Array, breaks: int | None = None) -> Words:
    """The words of each text. ``breaks``: a byte (say a line feed) that texts are cut at as well."""
    data, at = buffers(texts)
    return words_in(data, at)


def words_in(data: np.ndarray, at: np.ndarray) -> Words:
    """The words of the texts that lie in ``data`` between neighbours of ``at``."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, starts, ends, np.searchsorted(starts, at))


@dataclass
class Shingles:
    """Hashes of every run of ``size`` words; a shorter text with a word gives its whole self."""

    values: np.ndarray
    texts: np.ndarray


def shingles_of(words: Words, size: int = 5) -> Shingles:
    h, n = words.hashes(), words.counts()
    texts = words.texts()
    step = np.uint64(0xD6E8FEB86659FD93)
    # Every window of the batch at once; those across two texts are taken out.
    whole = max(len(h) - size + 1, 0)
    value = np.zeros(whole, np.uint64)
    for i in range(size):
        value = value * step + h[i : i + whole]
        value ^= value >> np.uint64(29)
    inside = texts[:whole] == texts[size - 1 :]
    value, owner = mix(value[inside]), texts[:whole][inside]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        first = words.offsets[:-1][short]
        rest = np.zeros(len(short), np.uint64)
        for i in range(size):
            word = np.where(i < n[short], h[np.minimum(first + i, len(h) - 1)], np.uint64(0))
            rest = rest * step + word
            rest ^= rest >> np.uint64(29)
        at = np.searchsorted(owner, short)
        value, owner = np.insert(value, at, mix(rest)), np.insert(owner, at, short)
    return Shingles(value, owner)


def batches_up_to(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` at most."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The same rows in tables of about ``rows``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class HashTable:
    """Numbers by 64-bit keys, in an open hash table looked up by whole arrays.

    ``missing`` is the value of a key that is not there; no key may be 2**64 - 1.
    """

    _FREE = np.uint64(2**64 - 1)

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self.missing = np.int32(missing)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, self._FREE, np.uint64)
        self.values = np.full(1 << self.bits, missing, np.int32)
        self.probes = 0
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            self.probes += 1
            at = slots[left]
            _, first = np.unique(at, return_index=True)
            takes = np.zeros(len(left), bool)
            takes[first] = True
            takes &= self.keys[at] == self._FREE
            self.keys[at[takes]] = keys[left[takes]]
            self.values[at[takes]] = values[left[takes]]
            left = left[~takes]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], self.missing)
        going = np.flatnonzero((found != keys) & (found != self._FREE))
        for _ in range(self.probes - 1):
            if not len(going):
                break
            at.flat[going] = (at.flat[going] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at.flat[going]]
            hit = found == keys.flat[going]
            out.flat[going[hit]] = self.values[at.flat[going[hit]]]
            going = going[~hit & (found != self._FREE)]
        return out


def most_frequent(counts: DataFrame, n: str, entries: int) -> DataFrame:
    """The rows with the largest ``n``, at most ``entries`` of them, in no order.

    ``counts`` is a written table, as it is read twice. Numbers are counted by
    sixteenths of a doubling, of which there are about a thousand at most, and rows are
    kept from the least such step on with which ``entries`` are not exceeded. So no task
    sends more than its part of the result, however many tasks there are. Rows of the
    step that does not fit are left out, and those without a count.
    """
    step = F.floor(F.log2(n) * 16)
    sizes = counts.filter(F.col(n) > 0).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()
    least, held = None, 0
    for size in sorted(sizes, key=lambda r: -r.step):
        held += size.rows
        if held > entries:
            break
        least = size.step
    return counts.filter((F.col(n) > 0) & (step >= least)) if least is not None else counts.limit(0)

"""Ranked lexical search over posting lists whose blocks are cut by similarity.

Terms are runs of ASCII letters and digits and of everything beyond ASCII, A-Z
lower-cased. A document scores the sum, over the query's terms, of the term's weight
times its impact in the document; all whole numbers.

Only terms that some query has are indexed. They are numbered from the rarest up,
and documents are laid out by their weightiest terms, so that neighbours are alike.
A run of neighbours is a shard. In a shard each term's posting list is cut into
blocks: some of its documents are pivots, and each joins the one it is most like. A
block is summed up by the highest impact of each coordinate among its documents, as
far as the coordinate's term is at least as common as the list's own.

That is enough to skip exactly. A document is found in the list of the rarest term
that it shares with the query; all others that they share are more common, so the
summary of its block there bounds its score. A block is left out only if that bound
is under a score which as many documents as are asked for are known to reach. Those
scores come from the best-looking block of each shard, scored when the shard is made.
What is not left out is scored in full.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelens.llm.common import HashTable, Words, batches_up_to, buffers, gathered, mix, words_in
from quotelens.sources.staging import Staging

#: Documents of a shard, at least (its last batch may go over), and of a block, about.
SHARD = 2_048
BLOCK = 64

#: Queries are taken in parts of about so many characters, which bounds what each task is sent.
QUERY_CHARS = 4_000_000

#: Coordinates that likeness is judged in.
SKETCH = 32

#: A coordinate is kept in a block's summary if an item may have both terms; by so many bits.
MASK_BITS = 1_024

EMPTY = (np.zeros(0, np.int64),) * 3

#: Entries that are looked at in one numpy call.
CHUNK = 1 << 20

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
for _low, _high, _shift in ((0x30, 0x39, 0), (0x41, 0x5A, 0x20), (0x61, 0x7A, 0)):
    _FOLD[_low : _high + 1] = np.arange(_low, _high + 1) + _shift


def terms_of(texts: pa.Array) -> Words:
    """The terms of each text, lower-cased."""
    data, at = buffers(texts)
    return words_in(_FOLD[data], at)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a column of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy()
    return (at - at[0]).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _list_of(at: np.ndarray, values: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of every span, one span after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


# --- queries --------------------------------------------------------------------


@dataclass
class Queries:
    """The distinct terms of each item, as places in ``keys``, the hashes of all of them."""

    ids: list
    keys: np.ndarray
    at: np.ndarray
    terms: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: pa.Array) -> Queries:
        words = terms_of(texts)
        keys, place = np.unique(words.hashes(), return_inverse=True)
        pairs = np.unique(words.texts() * max(len(keys), 1) + place)
        owner, terms = np.divmod(pairs, max(len(keys), 1))
        return cls(ids, keys, np.searchsorted(owner, np.arange(len(ids) + 1)), terms)

    def renumbered(self, place: np.ndarray) -> Queries:
        """With term ``i`` called ``place[i]``, ascending in each item."""
        terms = place[self.terms]
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.at))
        return Queries(self.ids, self.keys, self.at, terms[np.lexsort((terms, owner))])

    def masks(self) -> np.ndarray:
        """Bits of each term for the items it is in, items so far apart sharing one.

        Terms of one item share a bit; with more items than bits, so may others.
        """
        words = -(-min(max(len(self.ids), 1), MASK_BITS) // 64)
        found = np.zeros((len(self.keys), words), np.uint64)
        bit = np.repeat(np.arange(len(self.ids)), np.diff(self.at)) % (64 * words)
        np.bitwise_or.at(found, (self.terms, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
        return found


# --- documents ------------------------------------------------------------------


def _forward(keys: np.ndarray) -> Callable:
    """Each text's number of terms, and which of ``keys`` are in it how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = HashTable(keys, np.arange(len(keys), dtype=np.int32), -1)
        for batch in batches:
            words = terms_of(batch.column("text"))
            place = table.get(words.hashes()).astype(np.int64)
            known = place >= 0
            pairs, counts = np.unique(words.texts()[known] * max(len(keys), 1) + place[known], return_counts=True)
            owner, terms = np.divmod(pairs, max(len(keys), 1))
            at = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            n = words.counts()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), _list_of(at, terms, pa.int32()), _list_of(at, counts, pa.int32())],
                ["doc_id", "n", "terms", "counts"],
            )

    return run


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _weighed(place: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> Callable:
    """Impacts by renumbered term, and the three weightiest terms, by which documents are laid out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, terms = _lists(batch.column("terms"))
            _, counts = _lists(batch.column("counts"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(at))
            n = batch.column("n").to_numpy().astype(np.int64)
            m = 50 + (50 * n * n_docs) // n_terms
            impact = (1_000_000_000 * counts) // (1_000 * counts + 20 * m[owner])
            terms = place[terms]
            order = np.lexsort((terms, owner))
            terms, impact = terms[order], impact[order]
            best = np.lexsort((terms, -impact * weights[terms], owner))
            signs = []
            for k in range(3):
                there = at[:-1] + k < at[1:]
                sign = np.full(batch.num_rows, -1, np.int64)
                sign[there] = terms[best[at[:-1][there] + k]]
                signs.append(pa.array(sign, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), *signs, _list_of(at, terms, pa.int32()), _list_of(at, impact, pa.int32())],
                ["doc_id", "row", "first", "second", "third", "terms", "impacts"],
            )

    return run


# --- shards ---------------------------------------------------------------------


@dataclass
class Shard:
    """Documents with their impacts, and the blocks of every term's posting list."""

    docs: pa.Array
    at: np.ndarray
    terms: np.ndarray
    impacts: np.ndarray
    #: The list each block is of, ascending, and the documents of each block.
    block_terms: np.ndarray
    block_at: np.ndarray
    members: np.ndarray
    #: Highest impact of a coordinate in a block, ascending by coordinate.
    sum_terms: np.ndarray
    sum_blocks: np.ndarray
    sum_tops: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, weights: np.ndarray, masks: np.ndarray, block_docs: int) -> Shard:
        at, terms = _lists(table.column("terms"))
        _, impacts = _lists(table.column("impacts"))
        owner = np.repeat(np.arange(table.num_rows), np.diff(at))
        block = _blocks(at, terms, impacts, owner, weights, block_docs)
        order = np.lexsort((owner, block))
        block_at = np.concatenate([np.searchsorted(block[order], np.arange(block.max(initial=-1) + 1)), [len(order)]])
        block_terms = terms[order[block_at[:-1]]]
        sums = _summaries(at, terms, impacts, owner, block, block_terms, masks)
        docs = table.column("doc_id").combine_chunks()
        return cls(docs, at, terms, impacts, block_terms, block_at, owner[order], *sums)

    ARRAYS = (
        ("at", pa.int32()), ("terms", pa.int32()), ("impacts", pa.int32()),
        ("block_terms", pa.int32()), ("block_at", pa.int32()), ("members", pa.int32()),
        ("sum_terms", pa.int32()), ("sum_blocks", pa.int32()), ("sum_tops", pa.int32()),
    )

    def columns(self) -> dict[str, pa.Array]:
        found = {"docs": pa.ListArray.from_arrays(pa.array([0, len(self.docs)], pa.int32()), self.docs)}
        for name, kind in self.ARRAYS:
            values = getattr(self, name)
            found[name] = _list_of(np.array([0, len(values)]), values, kind)
        return found

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int) -> Shard:
        row = batch.slice(i, 1)
        docs = row.column("docs").flatten()
        return cls(docs, *[_lists(row.column(name))[1] for name, _ in cls.ARRAYS])

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The blocks of the query's lists, and what no document found there can score more than.

        Sums of whole numbers under 2**53, so doubles hold them exactly.
        """
        lists, ends = np.searchsorted(self.block_terms, terms), np.searchsorted(self.block_terms, terms, "right")
        blocks = _spans(lists, ends - lists)
        starts, ends = np.searchsorted(self.sum_terms, terms), np.searchsorted(self.sum_terms, terms, "right")
        entries = _spans(starts, ends - starts)
        gains = self.sum_tops[entries] * np.repeat(weights[terms], ends - starts)
        bound = np.bincount(self.sum_blocks[entries], gains, len(self.block_terms)).astype(np.int64)
        return blocks, bound[blocks]

    def scores(self, blocks: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents of the blocks and their whole scores."""
        docs = np.unique(self.members[_spans(self.block_at[blocks], self.block_at[blocks + 1] - self.block_at[blocks])])
        lengths = self.at[docs + 1] - self.at[docs]
        entries = _spans(self.at[docs], lengths)
        found = np.minimum(np.searchsorted(terms, self.terms[entries]), len(terms) - 1)
        gains = np.where(terms[found] == self.terms[entries], weights[self.terms[entries]] * self.impacts[entries], 0)
        owner = np.repeat(np.arange(len(docs)), lengths)
        return docs, np.bincount(owner, gains, len(docs)).astype(np.int64)


def _blocks(at, terms, impacts, owner, weights, size) -> np.ndarray:
    """The block of every posting: numbers ascend by term, then by pivot."""
    kinds, column = np.unique(terms, return_inverse=True)
    bits = mix(kinds.astype(np.uint64) + np.uint64(1))[:, None] >> np.arange(SKETCH, dtype=np.uint64)
    signs = (bits & np.uint64(1)).astype(np.float32) * 2 - 1
    gains = (weights[terms] * impacts).astype(np.float32)
    sketch = np.zeros((len(at) - 1, SKETCH), np.float32)
    i = 0
    while i < len(sketch):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK // SKETCH)) - 1)
        own = slice(at[i], at[j])
        filled = i + np.flatnonzero(np.diff(at[i : j + 1]))
        if len(filled):
            sketch[filled] = np.add.reduceat(gains[own, None] * signs[column[own]], at[filled] - at[i], axis=0)
        i = j
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
    order = np.argsort(terms, kind="stable")
    starts = np.flatnonzero(np.diff(terms[order], prepend=-1))
    ends = np.append(starts[1:], len(order))
    part = np.zeros(len(terms), np.int64)
    long = ends - starts > size
    for s, e in zip(starts[long], ends[long]):
        docs = owner[order[s:e]]
        count = -(-(e - s) // size)
        pivots = docs[(np.arange(count) * (e - s)) // count]
        part[order[s:e]] = np.argmax(sketch[docs] @ sketch[pivots].T, axis=1)
    return np.unique(terms * (len(at) + 1) + part, return_inverse=True)[1]


def _summaries(at, terms, impacts, owner, block, block_terms, masks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, block, highest impact) for terms at least as common as the block's own.

    Only of terms that some item may have together with the block's own.
    """
    kinds, column = np.unique(terms, return_inverse=True)
    order = np.argsort(block, kind="stable")
    blocks = block[order]
    # A document's terms ascend, so those not rarer than a posting's follow it.
    lengths = at[owner[order] + 1] - order
    found = []
    i = 0
    while i < len(order):
        last = np.searchsorted(blocks, block[order[i]] + max(1, CHUNK // len(kinds)))
        tops = np.zeros((block[order[last - 1]] - block[order[i]] + 1) * len(kinds), np.int64)
        ends = np.cumsum(lengths[i:last])
        j = 0
        while j < last - i:
            k = max(j + 1, int(np.searchsorted(ends, (ends[j - 1] if j else 0) + CHUNK)))
            own, n = order[i + j : i + k], lengths[i + j : i + k]
            entries = _spans(own, n)
            cells = np.repeat(block[own] - block[order[i]], n) * len(kinds) + column[entries]
            np.maximum.at(tops, cells, impacts[entries])
            j = k
        cells = np.flatnonzero(tops)
        own, other = block_terms[cells // len(kinds) + block[order[i]]], kinds[cells % len(kinds)]
        asked = np.zeros(len(cells), bool)
        for word in masks.T:
            asked |= (word[own] & word[other]) != 0
        cells = cells[asked]
        found.append((kinds[cells % len(kinds)], cells // len(kinds) + block[order[i]], tops[cells]))
        i = last
    if not found:
        return (np.zeros(0, np.int64),) * 3
    rows = [np.concatenate(x) for x in zip(*found)]
    by = np.lexsort((rows[1], rows[0]))
    return tuple(x[by] for x in rows)


def _best(docs: pa.Array, places: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Which of them lead: by score, then by id, rows without one last."""
    if len(scores) > top:
        floor = np.partition(scores, len(scores) - top)[len(scores) - top]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    ids = docs.take(pa.array(places[near]))
    without = ids.is_null().to_numpy(zero_copy_only=False)
    rank = np.argsort(np.argsort(ids.fill_null(0).to_numpy(), kind="stable"), kind="stable")
    return near[np.lexsort((rank, without, -scores[near]))[:top]]


def _shards(queries: Queries, weights: np.ndarray, top: int, shard_docs: int, block_docs: int) -> Callable:
    """A row per shard, with the best scores of each item's most promising block."""
    masks = queries.masks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches_up_to(batches, shard_docs), shard_docs):
            shard = Shard.of(table, weights, masks, block_docs)
            items, scores = [], []
            for i in range(len(queries.ids)):
                terms = queries.terms[queries.at[i] : queries.at[i + 1]]
                blocks, bound = shard.bounds(terms, weights)
                if len(blocks):
                    _, found = shard.scores(blocks[[np.argmax(bound)]], terms, weights)
                    found = np.sort(found[found > 0])[::-1][:top]
                    items.append(np.full(len(found), i))
                    scores.append(found)
            items, scores = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (items, scores)]
            ends = np.array([0, len(items)])
            columns = shard.columns() | {
                "seen_items": _list_of(ends, items, pa.int32()), "seen_scores": _list_of(ends, scores, pa.int64())
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _searched(queries: Queries, weights: np.ndarray, floors: np.ndarray, top: int) -> Callable:
    """The leading documents of a shard for each item, and how many blocks were skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard.read(batch, row)
                found, counts = [], []
                for i in range(len(queries.ids)):
                    terms = queries.terms[queries.at[i] : queries.at[i + 1]]
                    blocks, bound = shard.bounds(terms, weights)
                    left = blocks[(bound >= floors[i]) & (bound > 0)]
                    counts.append((i, len(blocks), len(left)))
                    if not len(left):
                        continue
                    docs, scores = shard.scores(left, terms, weights)
                    kept = np.flatnonzero((scores >= floors[i]) & (scores > 0))
                    docs, scores = docs[kept], scores[kept]
                    lead = _best(shard.docs, docs, scores, top)
                    found.append((np.full(len(lead), i), docs[lead], scores[lead]))
                items, docs, scores = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, EMPTY)]
                of, blocks, opened = np.array(counts, np.int64).reshape(-1, 3).T
                # Rows without a score carry the counts.
                none = len(of)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(items, of), pa.int32()),
                        pa.concat_arrays([shard.docs.take(pa.array(docs)), pa.nulls(none, shard.docs.type)]),
                        pa.concat_arrays([pa.array(scores, pa.int64()), pa.nulls(none, pa.int64())]),
                        pa.array(np.append(np.zeros(len(docs), np.int64), blocks)),
                        pa.array(np.append(np.zeros(len(docs), np.int64), opened)),
                    ],
                    ["item", "doc_id", "score", "n_blocks", "n_opened"],
                )

    return run


def _leading(rows: DataFrame, top: int, order: list) -> DataFrame:
    """The first ``top`` rows of each item with their ``rank``, cut in parts before they meet."""
    (salt,) = ("salt",)
    salted = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    for keys in (["item", salt], ["item"]):
        window = Window.partitionBy(*keys).orderBy(*order)
        salted = salted.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top)
    return salted.drop(salt)


def search(
    docs: DataFrame,
    items: DataFrame,
    staging: Staging,
    top: int = 50,
    explain: bool = False,
    shard_docs: int = SHARD,
    block_docs: int = BLOCK,
) -> DataFrame:
    """The ``top`` documents of highest score for each row of ``items``, exactly.

    ``docs`` has ``doc_id`` (a whole number) and ``text``, ``items`` has ``item_id``
    and ``text``; other columns are not read. Gives item_id, rank from 1, doc_id,
    score. Equal scores are ranked by id, rows without an id last; documents that
    share an id are ranked each. Null and empty texts have no terms: such documents
    count nowhere, such items give no rows. Each row of ``items`` is an item of its
    own. Scores are in 64 bits, for up to 10**17 as product of a document's terms and
    the documents.

    Terms are told apart by 64-bit hashes. ``explain`` gives the blocks that each
    item's lists have and those opened instead: item_id, n_blocks, n_opened.
    """
    asked = staging.table(
        items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")),
        "items",
    )
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // QUERY_CHARS))
    whole = [
        _search_part(
            docs, asked.filter(F.pmod(F.xxhash64("row"), F.lit(parts)) == part), staging, top, explain, shard_docs, block_docs
        )
        for part in range(parts)
    ]
    out = whole[0]
    for more in whole[1:]:
        out = out.unionByName(more)
    return out


def _search_part(
    docs: DataFrame, asked: DataFrame, staging: Staging, top: int, explain: bool, shard_docs: int, block_docs: int
) -> DataFrame:
    id_type = dict(docs.select("doc_id").dtypes)["doc_id"]
    given = asked.orderBy("row").toArrow()
    item_ids = given.column("item_id").to_pylist()
    queries = Queries.of(item_ids, given.column("text").combine_chunks())
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    forward = texts.mapInArrow(_forward(queries.keys), f"doc_id {id_type}, n long, terms array<int>, counts array<int>")
    forward = staging.table(forward.filter("n > 0").withColumn("row", F.monotonically_increasing_id()), "forward")
    n_docs, n_terms = forward.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(queries.keys), np.int64)
    for term, count in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = count
    # The rarest is 0.
    by_rarity = np.argsort(df, kind="stable")
    place = np.empty(len(df), np.int64)
    place[by_rarity] = np.arange(len(df))
    weights = term_weights(n_docs, df[by_rarity])
    queries = queries.renumbered(place)
    weighed = (
        forward.filter(F.size("terms") > 0)
        .select("doc_id", "n", "terms", "counts", "row")
        .mapInArrow(
            _weighed(place, weights, n_docs, n_terms or 1),
            f"doc_id {id_type}, row long, first int, second int, third int, terms array<int>, impacts array<int>",
        )
    )
    layout = ["first", "second", "third", "row"]
    near = weighed.repartitionByRange(*layout).sortWithinPartitions(*layout).select("doc_id", "terms", "impacts")
    arrays = ", ".join(f"{name} array<int>" for name, _ in Shard.ARRAYS)
    shards = near.mapInArrow(
        _shards(queries, weights, top, shard_docs, block_docs),
        f"docs array<{id_type}>, {arrays}, seen_items array<int>, seen_scores array<long>",
    )
    shards = staging.table(shards, "shards")
    seen = shards.select(F.explode(F.arrays_zip("seen_items", "seen_scores")).alias("s")).select(
        F.col("s.seen_items").alias("item"), F.col("s.seen_scores").alias("score")
    )
    floors = np.zeros(len(item_ids), np.int64)
    reached = _leading(seen, top, [F.col("score").desc()]).filter(F.col("rank") == top)
    for item, score in reached.select("item", "score").collect():
        floors[item] = score
    names = asked.sparkSession.createDataFrame(
        pa.table({"item": pa.array(range(len(item_ids)), pa.int32()), "item_id": given.column("item_id")})
    )
    found = shards.drop("seen_items", "seen_scores").mapInArrow(
        _searched(queries, weights, floors, top), f"item int, doc_id {id_type}, score long, n_blocks long, n_opened long"
    )
    if explain:
        counts = found.filter(F.col("score").isNull()).groupBy("item").agg(F.sum("n_blocks").alias("n_blocks"), F.sum("n_opened").alias("n_opened"))
        return counts.join(names, "item").select("item_id", "n_blocks", "n_opened")
    scored = found.filter(F.col("score").isNotNull()).select("item", "doc_id", "score")
    lead = _leading(scored, top, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    return lead.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search_sql(top: int = 50) -> str:
    """:func:`search` in DuckDB, by scoring every document."""
    terms = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return rf"""
WITH words AS (
    SELECT k, doc_id, unnest(regexp_extract_all(translate(text, {lower}), '{terms}')) AS term
    FROM (SELECT row_number() OVER () AS k, doc_id, text FROM documents)
), tfs AS (
    SELECT k, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words GROUP BY k, term
), lengths AS (
    SELECT k, sum(tf)::BIGINT AS n FROM tfs GROUP BY k
), totals AS (
    SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM lengths
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM tfs, totals GROUP BY term
), asked AS (
    SELECT DISTINCT r, item_id, unnest(regexp_extract_all(translate(text, {lower}), '{terms}')) AS term
    FROM (SELECT row_number() OVER () AS r, item_id, text FROM benchmark)
), scored AS (
    SELECT r, any_value(item_id) AS item_id, k, any_value(doc_id) AS doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nn) // ll)))))::BIGINT AS score
    FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (k), totals GROUP BY r, k
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id NULLS LAST) AS place
    FROM scored WHERE score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= {top}
"""

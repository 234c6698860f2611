"""Near-duplicate documents by dart signatures and banded joining.

A document is a weighted set of shingles. Each unit of weight of a shingle is a
region of its own, onto which darts fall by one fixed Poisson process: the gaps
between their ranks are exponential numbers made by hashing (shingle, unit,
number of the dart). A document takes the darts whose rank is below a bound that
falls with its total weight, so that about ``K (ln K + 2)`` of them lie on its
regions whatever its size. The dart's hash gives its coordinate, and each of the
``K`` coordinates keeps its earliest dart. Two documents agree in a coordinate
with the probability of their weighted Jaccard similarity. A document that
misses a coordinate, which one in ten does, is thrown at with twice the bound.

Coordinates are joined in ``BANDS`` bands of ``ROWS``: two documents at similarity
0.8 share no band with probability 1e-4. In each band every document is compared
with one that leads it, exactly, on its shingles: the one that meets most others in
its bands, which in a family of copies is close to what they were copied from.

Where some are less than similar to their lead, links among its followers are found
by what they and the lead do not share. Two texts x and y of sizes |x| and |y| are
similar if and only if they differ in at most (|x| + |y|) / 9 shingles, and they
differ where exactly one of them differs from the lead. So x and y, with differences
X and Y, have at least (|X| + |Y| - (|x| + |y|) / 9) / 2 of these in common. That is
more than half of Y if x is not similar to the lead, and edits of their own, which
come first as the rarest, fill the other half of it. So a prefix of each text's
differences is joined, the rarest first, and what meets there is compared, if no
link so far connects it. No link is lost, and pairs within a group are not made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelens.llm.common import Words, free_name, shingles_of, text_of, words_of
from quotelens.sources.staging import Staging

SHINGLE_WORDS = 5
#: The numbers in :func:`_other_candidates` follow from it.
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
K = BANDS * ROWS

_U = np.uint64
_STEP, _TURN = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _gap(h: np.ndarray) -> np.ndarray:
    """An exponential number of mean one from a hash."""
    return -np.log(((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)


def weighted(values: np.ndarray, texts: np.ndarray, by_count: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text, the text, and the weight: occurrences, or one."""
    order = np.lexsort((values, texts))
    values, texts = values[order], texts[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (texts[1:] != texts[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(values))) if by_count else np.ones(len(at), np.int64)
    return values[at], texts[at], weight


def _units(values: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A hash of each unit of weight of each shingle."""
    within = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    return _mixed(np.repeat(values, weight) + _STEP * (within.astype(_U) + _U(1)))


def dart_signatures(
    values: np.ndarray, texts: np.ndarray, weight: np.ndarray, n: int, k: int = K
) -> np.ndarray:
    """Hashes of the earliest dart per coordinate: ``n`` rows of ``k``, zeros for a text without shingles.

    ``values`` of ``texts``, ascending by text, with whole-number ``weight``.
    """
    unit_text = np.repeat(texts, weight)
    region = _units(values, weight)
    total = np.bincount(unit_text, minlength=n).astype(np.float64)
    signature = np.zeros((n, k), _U)
    todo, darts = total > 0, k * (np.log(k) + 2)
    while todo.any():
        bound = np.divide(darts, total, out=np.zeros(n), where=todo)
        at = np.flatnonzero(todo[unit_text])
        owner, seed, rank, found = unit_text[at], region[at], np.zeros(len(at)), []
        throw = 1
        while len(owner):
            dart = _mixed(seed + _U(int(_TURN) * throw % 2**64))
            rank = rank + _gap(dart)
            hit = rank < bound[owner]
            owner, seed, rank, dart = owner[hit], seed[hit], rank[hit], dart[hit]
            found.append((owner, rank, dart))
            throw += 1
        owner, rank, dart = (np.concatenate(x) for x in zip(*found))
        dart = _mixed(dart + _STEP)
        cell = owner * k + (dart % _U(k)).astype(np.int64)
        order = np.lexsort((rank, cell))
        cell, first = np.unique(cell[order], return_index=True)
        signature.flat[cell] = dart[order][first] | _U(1)
        todo &= (signature == 0).any(1)
        darts *= 2
    return signature


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash per band of a signature, the band's number in it."""
    n, k = signature.shape
    key = np.zeros((n, k // rows), _U) + np.arange(k // rows, dtype=_U) * _STEP
    for i in range(rows):
        key = _mixed(key * _U(31) + signature[:, i::rows])
    return key.astype(np.int64)


def jaccard(a: np.ndarray, aw: np.ndarray, b: np.ndarray, bw: np.ndarray) -> float:
    """Weighted Jaccard similarity of two ascending arrays of distinct hashes."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    low = np.minimum(aw[i], bw[j]).sum()
    return float(low / (aw.sum() + bw.sum() - low))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _names(words: Words) -> np.ndarray:
    """A hash of the words of each text in their order."""
    h, n = words.hashes(), words.counts()
    position = np.arange(len(h)) - np.repeat(words.offsets[:-1], n)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_mixed(h + _STEP * (position.astype(_U) + _U(1))))])
    return _mixed(sums[words.offsets[1:]] - sums[words.offsets[:-1]] + n.astype(_U))


def sketch_documents(df: DataFrame, by_count: bool = False) -> DataFrame:
    """Per row ``doc_id``, ``mark`` of the text, ``name`` of its word sequence, ``words`` and band ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words = words_of(batch.column(2))
            shingles = shingles_of(words, SHINGLE_WORDS)
            keys = band_keys(dart_signatures(*weighted(shingles.values, shingles.texts, by_count), n))
            offsets = np.arange(n + 1, dtype=np.int32) * keys.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    _signed(_names(words)),
                    pa.array(words.counts().astype(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                ],
                names=schema.names,
            )

    schema = df.select("doc_id").schema.add("mark", "long").add("name", "long")
    schema = schema.add("words", "long").add("keys", T.ArrayType(T.LongType()))
    return df.select("doc_id", F.xxhash64(text_of()), text_of()).mapInArrow(run, schema)


def _weights(df: DataFrame, by_count: bool) -> DataFrame:
    """``name`` of each text with its distinct shingles, ascending, and their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch.column(0))
            shingles = shingles_of(words, SHINGLE_WORDS)
            values, texts, weight = weighted(shingles.values, shingles.texts, by_count)
            offsets = np.searchsorted(texts, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(_names(words)),
                    pa.ListArray.from_arrays(offsets, _signed(values)),
                    pa.ListArray.from_arrays(offsets, pa.array(weight.astype(np.int32))),
                ],
                names=["name", "shingles", "weights"],
            )

    return df.select(text_of()).mapInArrow(run, "name long, shingles array<long>, weights array<int>")


def _arrays(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    cell = column[i]
    return (
        cell["shingles"].values.to_numpy(zero_copy_only=False).view(_U),
        cell["weights"].values.to_numpy(zero_copy_only=False),
    )


def _side_by_side(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """``pairs`` of names ``a`` and ``b`` with the weighted shingles ``x`` and ``y`` of each."""
    ours = weights.select(F.col("name").alias("a"), F.struct("shingles", "weights").alias("x"))
    theirs = weights.select(F.col("name").alias("b"), F.struct("shingles", "weights").alias("y"))
    return pairs.join(ours, "a").join(theirs, "b").select("a", "b", "x", "y")


def _compared(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """``pairs`` of names ``a`` and ``b`` with their exact similarity ``s``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            found = [jaccard(*_arrays(x, i), *_arrays(y, i)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "s"]
            )

    return _side_by_side(pairs, weights).mapInArrow(run, "a long, b long, s double")


def _differences(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """``pairs`` with the total weights ``n`` of ``a`` and ``m`` of ``b``, and ``differ``, the units that one of them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            units = [(_units(*_arrays(x, i)), _units(*_arrays(y, i))) for i in range(batch.num_rows)]
            differ = [np.setxor1d(p, q, assume_unique=True) for p, q in units]
            offsets = np.cumsum([0, *map(len, differ)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(p) for p, _ in units], pa.int64()),
                    pa.array([len(q) for _, q in units], pa.int64()),
                    pa.ListArray.from_arrays(offsets, _signed(np.concatenate([np.zeros(0, _U), *differ]))),
                ],
                names=["a", "b", "n", "m", "differ"],
            )

    return _side_by_side(pairs, weights).mapInArrow(run, "a long, b long, n long, m long, differ array<long>")


def components(links: DataFrame, staging: Staging) -> DataFrame:
    """``name`` and ``root``, the smallest name linked to it over any path, by star contraction.

    Each round ties every neighbour of a node to the smallest one, first those
    above the node, then those below, until nothing moves. Every round is written
    to the shared folder; only a count and a checksum reach the driver.
    """
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    links, mark = staging.table(links, "links"), None
    while True:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        links = staging.table(small, "links")
        now = links.agg(
            F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))
        ).first()
        if now == mark:
            return links.groupBy(F.col("u").alias("name")).agg(F.min("v").alias("root"))
        mark = now


def text_classes(df: DataFrame, texts: DataFrame, staging: Staging, by_count: bool = False) -> DataFrame:
    """``name`` and ``root`` for the texts that are near-duplicates of another, different text.

    ``texts``: ``name``, one per distinct text, ``first``, the id of a row of
    ``df`` that has it, and its band ``keys``. Names of one class get the
    smallest name among them.
    """
    bands = staging.table(texts.select("name", F.explode("keys").alias("band")), "bands")
    # A band's summary is a few numbers wide, so a hot band costs a row per task.
    sizes = bands.groupBy("band").agg(
        F.min("name").alias("a"), F.max("name").alias("b"), F.count("*").alias("size")
    )
    met = staging.table(bands.join(sizes.filter("a < b").select("band", "size"), "band"), "met")
    # Who meets most others leads.
    known = staging.table(met.groupBy("name").agg(F.sum("size").alias("meets")), "known")
    leads = met.join(known, "name").groupBy("band").agg(F.max(F.struct("meets", "name"))["name"].alias("lead"))
    to_lead = met.join(leads, "band").filter("name <> lead").select(F.col("name").alias("a"), F.col("lead").alias("b"))
    ids = texts.select("name", F.col("first").alias("doc_id")).join(known, "name", "left_semi")
    weights = _weights(df.join(ids, "doc_id", "left_semi"), by_count)
    weights = weights.join(known, "name", "left_semi").dropDuplicates(["name"])
    weights = staging.table(weights, "weights")
    scored = staging.table(_compared(to_lead.distinct(), weights), "scored")
    links = scored.filter(F.col("s") >= SIMILARITY).select("a", "b")
    roots = staging.table(components(links, staging), "roots")
    rest = _other_candidates(scored, roots, weights, staging)
    more = staging.table(_compared(rest, weights).filter(F.col("s") >= SIMILARITY), "more")
    if more.isEmpty():
        return roots
    return components(links.union(more.select("a", "b")), staging)


def _other_candidates(scored: DataFrame, roots: DataFrame, weights: DataFrame, staging: Staging) -> DataFrame:
    """Pairs ``a`` and ``b`` of different classes that follow one lead and that may be similar.

    ``scored``: texts ``a`` with their leads ``b`` and how similar they are; ``roots``: classes so far.
    Of two followers in different classes one at least, ``apart``, is not in the class of the lead.
    """
    ours = roots.select(F.col("name").alias("a"), F.col("root").alias("class"))
    theirs = roots.select(F.col("name").alias("b"), F.col("root").alias("lead_class"))
    placed = (
        scored.join(ours, "a", "left")
        .join(theirs, "b", "left")
        .select(
            "a", "b", "s",
            F.coalesce("class", "a").alias("class"),
            (F.coalesce("class", "a") != F.coalesce("lead_class", "b")).alias("apart"),
        )
    )
    # Who has just the shingles of the lead is as near to anyone as the lead itself.
    placed = staging.table(placed.filter("s < 1"), "placed")
    open_ = placed.join(placed.filter("apart").select("b").distinct(), "b", "left_semi")
    differ = staging.table(_differences(open_.select("a", "b"), weights), "differ")
    parts = (
        differ.join(open_.select("a", "b", "class", "apart"), ["a", "b"])
        .withColumn("k", F.size("differ").cast("long"))
        .select("a", "b", "n", "m", "k", "class", "apart", F.explode("differ").alias("part"))
    )
    shared = parts.groupBy("b", "part").agg(F.count("*").alias("held"), F.bool_or("apart").alias("asked"))
    # ``left``: how many shared differences there are from this one on, the rarest being the first.
    last_first = Window.partitionBy("b", "a").orderBy(F.desc("held"), F.desc("part"))
    ranked = (
        parts.join(shared.filter("held > 1 and asked").select("b", "part", "held"), ["b", "part"])
        .withColumn("left", F.row_number().over(last_first))
        # A similar text has at most a quarter of n other differences.
        .filter("4 * left >= 4 * k - n")
    )
    ranked = staging.table(ranked, "ranked")
    x = ranked.filter("apart").alias("x")
    y = ranked.filter("18 * left > 9 * k + m - n").alias("y")
    need = F.expr("9 * (x.k + y.k) - x.n - y.n")
    return (
        x.join(y, ["b", "part"])
        .filter((F.col("x.class") != F.col("y.class")) & (18 * F.col("x.left") >= need) & (18 * F.col("y.left") >= need))
        .select(F.least("x.a", "y.a").alias("a"), F.greatest("x.a", "y.a").alias("b"))
        .distinct()
    )


def near_duplicate_classes(df: DataFrame, staging: Staging, by_count: bool = False) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``mark`` and ``name`` of its text, and ``class_id``.

    The class is named by the smallest id in it. Weights are occurrences of
    shingles if ``by_count``, else one each, which makes the similarity the plain
    Jaccard similarity of their sets. Rows whose texts have the same words in the
    same order are copies; texts of fewer than five words are alike only so. Rows
    without a word, or without an id, are in no class: ``class_id`` is their own
    id. Repeated rows are in one class. Other columns are not looked at.
    """
    rows = staging.table(sketch_documents(df, by_count), "rows")
    whole = rows.filter("words > 0 and doc_id is not null")
    # The smallest id of a text carries it on; its copies are not looked at again.
    texts = whole.groupBy("name").agg(F.min("doc_id").alias("first"), F.any_value("keys").alias("keys"))
    texts = staging.table(texts, "texts")
    roots = text_classes(df, texts, staging, by_count)
    rooted = texts.select("name", "first").join(roots, "name", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "name"))
    least = rooted.groupBy("root").agg(F.min("first").alias("class_id"))
    classes = staging.table(rooted.join(least, "root").select("name", "class_id"), "classes")
    found = whole.join(classes, "name").select("doc_id", "mark", "name", "class_id")
    alone = rows.filter("words = 0 or doc_id is null")
    return found.union(alone.select("doc_id", "mark", "name", F.col("doc_id").alias("class_id")))


def drop_near_duplicates(df: DataFrame, staging: Staging, by_count: bool = False) -> DataFrame:
    """The rows of ``df`` that stay: of each class the one with the smallest id.

    Rows without a word or an id all stay. Of several rows with that id, words
    and class the one with the smallest hash of its text stays, once. Columns of
    any name pass through.
    """
    (mark,) = free_name(df, "__mark")
    classes = near_duplicate_classes(df, staging, by_count)
    chosen = (
        classes.filter("doc_id = class_id")
        .groupBy("doc_id", "name")
        .agg(F.min("mark").alias(mark), F.count("*").alias("n"))
    )
    chosen = staging.table(chosen, "chosen")
    marked = df.withColumn(mark, F.xxhash64(text_of()))
    once = marked.join(chosen.filter("n = 1"), ["doc_id", mark], "left_semi")
    again = marked.join(chosen.filter("n > 1"), ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return once.unionByName(again).unionByName(marked.filter("doc_id is null")).select(*df.columns)

"""Threshold-scaled sketches of documents.

A fingerprint keeps the hash of every shingle of five words that lies below a
fixed fraction of the hash space, and its ``LOWEST`` lowest hashes in any case. Its size
follows the document, a text of few shingles is kept whole, and sketches of parts
merge by union. Two sketches are compared up to the hash to which both are without
gaps, so the part of a short document that a long one contains is ``|A n B| / |A|`` over
the hashes up to there, and exact where both are whole. Nothing but the two
fingerprints goes into it. Texts without a word have the empty fingerprint.

A fingerprint is base64 of the sorted hashes, eight bytes each, low byte first.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelens.llm.common import Shingles, free_name, shingles_of, text_of, words_of

SHINGLE_WORDS = 5
#: One hash in so many is kept.
SCALED = 2
#: So many of a text's lowest hashes are kept wherever they lie.
LOWEST = 64
#: Rows of a bucket of :func:`edited_likeness`, about.
BUCKET_ROWS = 512
#: Quantiles asked of one aggregate at most; more rows make larger buckets.
MOST_BUCKETS = 20_000


def threshold(scaled: int = SCALED) -> np.uint64:
    return np.uint64((2**64 - 1) // scaled)


def _distinct(values: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes once, ascending, text by text."""
    order = np.lexsort((values, texts))
    values, texts = values[order], texts[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (texts[1:] != texts[:-1])
    return values[new], texts[new]


def sketches(shingles: Shingles, n: int, scaled: int = SCALED) -> list[np.ndarray]:
    """The sketch of each of ``n`` texts: its distinct kept hashes, ascending."""
    if not n:
        return []
    low = shingles.values <= threshold(scaled)
    values, texts = _distinct(shingles.values[low], shingles.texts[low])
    found = np.split(values, np.searchsorted(texts, np.arange(1, n)))
    short = np.bincount(texts, minlength=n) < LOWEST
    of_short = short[shingles.texts]
    values, texts = _distinct(shingles.values[of_short], shingles.texts[of_short])
    whole = np.split(values, np.searchsorted(texts, np.arange(1, n)))
    return [whole[i][:LOWEST] if short[i] else found[i] for i in range(n)]


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def merge(parts: list[np.ndarray], scaled: int = SCALED) -> np.ndarray:
    """The sketch of all parts together."""
    whole = np.unique(np.concatenate([np.empty(0, np.uint64), *parts]))
    return whole[: max(LOWEST, int(np.searchsorted(whole, threshold(scaled), "right")))]


def _reach(sketch: np.ndarray, scaled: int) -> np.uint64:
    """The hash up to which a sketch has every hash of its text."""
    if len(sketch) < LOWEST:
        return np.uint64(2**64 - 1)
    return max(threshold(scaled), sketch[-1])


def _comparable(a: np.ndarray, b: np.ndarray, scaled: int) -> tuple[np.ndarray, np.ndarray]:
    """Both up to the hash to which neither has gaps."""
    reach = min(_reach(a, scaled), _reach(b, scaled))
    return tuple(s[: np.searchsorted(s, reach, "right")] for s in (a, b))


def containment(a: np.ndarray, b: np.ndarray, scaled: int = SCALED) -> float:
    """The estimated part of ``a``'s shingles that ``b`` has too, 0 to 1.

    Two texts without a word contain each other; one without contains none. NaN,
    for unknown, where all hashes of ``a`` lie beyond those that ``b`` has kept.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = _comparable(a, b, scaled)
    if not len(a):
        return float("nan")
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def jaccard(a: np.ndarray, b: np.ndarray, scaled: int = SCALED) -> float:
    """The estimated Jaccard similarity; 1 for two texts without a word."""
    if not len(a) and not len(b):
        return 1.0
    a, b = _comparable(a, b, scaled)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def fingerprint_documents(
    df: DataFrame, text: str = "text", out: str = "fingerprint", scaled: int = SCALED
) -> DataFrame:
    """``df`` with the fingerprint of each text. Null is empty; nothing is shuffled.

    ``out`` replaces a column of that name.
    """
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches(shingles_of(words_of(batch.column(len(kept))), SHINGLE_WORDS), batch.num_rows, scaled)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array([encode(s) for s in found], pa.string())],
                names=[*kept, out],
            )

    schema = df.select(*kept).schema.add(out, "string")
    (source,) = free_name(df, "__text")
    return df.select(*kept, text_of(text).alias(source)).mapInArrow(run, schema)


def merge_fingerprints(df: DataFrame, keys: list[str], fingerprint: str = "fingerprint", scaled: int = SCALED) -> DataFrame:
    """The fingerprint of each group as if its documents were one.

    Hashes are made distinct per map task before they meet, and are spread by
    hash, so a group of a third of all rows is not gathered; only its result,
    one hash in ``scaled`` of its shingles, is one value.
    """
    hashes = F.udf(lambda f: [int(h) for h in decode(f).astype(np.int64)], T.ArrayType(T.LongType()))
    joined = F.udf(lambda hs: encode(merge([np.array(hs, np.int64).astype(np.uint64)], scaled)), T.StringType())
    return (
        df.select(*keys, F.explode_outer(hashes(F.coalesce(fingerprint, F.lit("")))).alias("h"))
        .distinct()
        .groupBy(*keys)
        .agg(joined(F.collect_list("h")).alias(fingerprint))
    )


def _order_key(doc_id: Column) -> Column:
    """Null sorts as the smallest id."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)))


def _place(rank):
    """Falls as the hash of a text rises, in 53 bits, which quantiles tell apart."""
    return F.shiftright(F.bitwise_not(rank), 11) if isinstance(rank, Column) else ~rank >> 11


def _existing(source: DataFrame, bounds: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``bounds`` of ids beyond 53 bits, which quantiles round, replaced by the greatest id up to each."""
    if not (np.abs(bounds[bounds > -(2**63)].astype(float)) >= 2.0**53).any():
        return bounds, times
    shared = source.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def bucket(keys):
        return type(keys)(np.searchsorted(shared.value, keys.to_numpy()))

    rows = source.groupBy(bucket("key").alias("i")).agg(F.max("key").alias("most")).orderBy("i").collect()
    return np.array([r.most for r in rows], np.int64), times[[r.i for r in rows]]


def _cuts(source: DataFrame, bounds: np.ndarray, times: np.ndarray) -> dict[int, np.ndarray]:
    """For ids that are several quantiles at once, where to cut their rows, by :func:`_place`.

    Cuts are numbers of rows that exist, the greatest being the last, so no bucket is empty. Nothing
    is read if no id is that frequent; else the texts are hashed once per doubling of the frequency.
    """
    found, place = {}, _place(F.xxhash64("text"))
    for size in np.unique(np.log2(times[times > 1]).astype(int)).tolist():
        keys = bounds[np.log2(times).astype(int) == size].tolist()
        parts = 2 ** (size + 1)
        rows = source.filter(F.col("key").isin(keys)).groupBy("key").agg(
            F.percentile_approx(place, [(i + 1) / parts for i in range(parts)], 10 * parts).alias("q"),
            F.max(place).alias("most"),
        )
        found |= {r.key: np.unique(np.array([*r.q, r.most], np.int64)) for r in rows.collect()}
    return found


def edited_likeness(df: DataFrame, scaled: int = SCALED) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are.

    ``near_edited`` and ``near_next`` estimate the part of the document that the
    edited text and the next document contain; two more columns have the Jaccard
    similarity. All four are worked out from the two fingerprints alone. A containment
    that they do not tell is 0: no hash of the one was found in the other.

    The edited text: the last floor(n/2) of n characters replaced by the first
    as many, or all, of the next document by descending ``doc_id``; after the
    last comes the first. Rows of one id follow each other by the hash of their
    text; a null id is the last and a null text empty. An only document is its own next.

    Ids are cut into buckets at quantiles, of about ``BUCKET_ROWS`` rows, so each
    text is shuffled once and read once, in order; memory is that of a batch. The
    rows at a bucket's upper end travel twice, the second time as the successor of
    the bucket above it. An id of several buckets' rows, a null one for instance, is
    cut by the hash of its texts; only rows alike in id and text are never parted.
    """
    spark = df.sparkSession
    source = df.select(_order_key(F.col("doc_id")).alias("key"), "doc_id", text_of().alias("text"))
    n = source.count()
    buckets = min(MOST_BUCKETS, max(1, n // BUCKET_ROWS))
    ends = source.agg(
        F.percentile_approx("key", [(i + 1) / buckets for i in range(buckets)], 10 * buckets).alias("q"),
        F.max("key").alias("most"),
    ).first()
    bounds, times = np.unique(np.array(ends.q or [0], np.int64), return_counts=True)
    if n and bounds[-1] < ends.most:
        bounds, times = np.append(bounds, ends.most), np.append(times, 1)
    bounds, times = _existing(source, bounds, times)
    cuts = _cuts(source, bounds, times)
    # A key's upper ends stand in its place, in ascending order; most keys have one.
    limits = np.repeat(bounds, [len(cuts.get(b, ())) or 1 for b in bounds.tolist()])
    shared = spark.sparkContext.broadcast((limits, cuts))

    @F.pandas_udf("array<int>")
    def places(keys, ranks):
        """Its own bucket, and for an upper end the next one, whose last row it follows."""
        limits, cuts = shared.value
        keys, place = keys.to_numpy(), _place(ranks.to_numpy())
        at = np.searchsorted(limits, keys)
        top = limits[at] == keys
        for key in cuts.keys() & set(keys[top].tolist()) if cuts else ():
            of = keys == key
            at[of] += np.searchsorted(cuts[key], place[of])
        return type(ranks)([[i, (i + 1) % len(limits)] if t else [i] for i, t in zip(at.tolist(), top.tolist())])

    dealt = (
        source.withColumn("rank", F.xxhash64("text"))
        .select("*", F.posexplode(places("key", "rank")).alias("copy", "bucket"))
        .repartition("bucket")
        # In a bucket ids descend; successors from the bucket below come last.
        .sortWithinPartitions("bucket", "copy", F.desc("key"), "rank")
        .select("bucket", "copy", "doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its successor
        for batch in batches:
            found = sketches(shingles_of(words_of(batch.column(3)), SHINGLE_WORDS), batch.num_rows, scaled)
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), found)
            pairs = []
            for row in rows:
                if held is not None and held[0] == row[0] and held[1] == 0:
                    pairs.append((held, row))
                held = row
            if pairs:
                yield compared(pairs)

    def compared(pairs: list) -> pa.RecordBatch:
        edited = []
        for (_, _, _, text, _), (_, _, _, following, _) in pairs:
            cut = len(text) // 2
            edited.append(text[: len(text) - cut] + following[:cut])
        changed = sketches(shingles_of(words_of(pa.array(edited, pa.string())), SHINGLE_WORDS), len(edited), scaled)
        kept = [(a[4], c, b[4]) for (a, b), c in zip(pairs, changed)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([a[2] for a, _ in pairs], id_type),
                pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array([encode(k[0]) for k in kept]),
                pa.array([encode(s) for s in changed]),
                pa.array(np.nan_to_num([containment(a, c, scaled) for a, c, _ in kept])),
                pa.array(np.nan_to_num([containment(a, b, scaled) for a, _, b in kept])),
                pa.array([jaccard(a, c, scaled) for a, c, _ in kept], pa.float64()),
                pa.array([jaccard(a, b, scaled) for a, _, b in kept], pa.float64()),
            ],
            names=schema.names,
        )

    schema = (
        df.select("doc_id")
        .schema.add("n_chars", "long")
        .add("edited_sha256", "string")
        .add("fingerprint", "string")
        .add("edited_fingerprint", "string")
        .add("near_edited", "double")
        .add("near_next", "double")
        .add("jaccard_edited", "double")
        .add("jaccard_next", "double")
    )
    id_type = pa.int32() if schema["doc_id"].dataType == T.IntegerType() else pa.int64()
    return dealt.mapInArrow(run, schema)

"""Repeated and nearly repeated lines, by a deletion-neighbourhood join.

A line is the sequence of its words; its edits are words put in, taken out or
replaced. Two lines are at most ``EDITS`` = 1 edit apart if and only if both,
without one word at the same place, are equal, or one of them without a word
is the other. So each line sends the hash of itself and of itself without each
word, equal hashes are joined, and what was found is confirmed by the edit
distance of the texts. A line goes if an earlier one, by ``doc_id`` and place, is
equal to it or one edit away; the earliest stays. With ``MIN_WORDS`` words or more
that is a similarity of 0.8 at least. Shorter lines are compared for equality only,
and only those of ``least`` words: by default they stay, as in the SQL.

The neighbourhood of a line is as large as the line, so only lines that can have
a partner send it: two lines one edit apart share their first or their last half
of the shorter one's words, word for word. Halves of all distinct lines are
joined first, which loses nothing.

If asked (``grow``), the bound grows with the line: one edit in ``EDIT_WORDS`` words
of the longer one, a similarity of 0.8 at any length. Lines that many edits apart
share a pair of neighbouring words among the rarest of each that so many edits
cannot all touch. Which words count as rare comes from a sample and is the same for
all lines, so it changes the time and not the result. A line is compared with
the earliest that shares such a pair; those not gone by then with every earlier one.
A pair that many lines have is hot: the lines that have one are told by their rarest
pairs again, with hot ones last. What still meets in hot pairs, say as a long passage is
common, is compared by wide sketches there.
Before the words of two lines are, sketches of them are, which rule out only what the
bound does.

Hot lines and hot halves cost a row per map task: all that is asked of a group is
its earliest member. No pairs within a group are made.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelens.llm.common import SPACES, Words, buffers, free_name, mix, most_frequent, text_of, words_in
from quotelens.sources.staging import Staging

MIN_WORDS = 5
EDITS = 1
#: With a growing bound, one edit in so many words of the longer line.
EDIT_WORDS = 5
#: Texts and words of the sample that says which words are rare.
SAMPLE_TEXTS, SAMPLE_WORDS = 1_000, 65_536
#: A pair among the rarest of more lines is hot. So many are put last at once, the hottest, and lines told again so often.
HOT_LINES, HOT_PAIRS, TURNS = 64, 1 << 18, 2
#: Words of a line and places of its pairs are told apart up to these numbers; a greater one fits any.
MOST_WORDS, MOST_PLACE = 2**21 - 1, 2**20 - 1
#: Before the words of two lines are compared, so many times 64 bits that tell of their words are.
SKETCH_LONGS = 8
#: Texts are gone over in pieces of so many bytes, as numbers of their words take some fifty times that.
PIECE_BYTES = 1 << 18
#: Documents with a line to compare whose ids (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 500_000

_U = np.uint64
_STEP, _SIDE, _SIZE = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
_WORD_CHARACTER = SPACES.replace("[", "[^", 1)
#: Sorts after every id.
_LAST = 2**63 - 1


def _pieces(batches: Iterator[pa.RecordBatch], texts: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``PIECE_BYTES`` of text at most, or of one row."""
    for batch in batches:
        _, at = buffers(batch.column(texts))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + PIECE_BYTES, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def _lines(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of all lines of a batch, with the text and the number of each line."""
    data, at = buffers(texts)
    breaks = np.flatnonzero(data == 0x0A) + 1
    # A line begins where a text begins and after each line feed.
    starts = np.concatenate([at[:-1], breaks])
    owners = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, breaks - 1, "right") - 1])
    order = np.lexsort((starts, owners))
    starts, owners = starts[order], owners[order]
    number = np.arange(len(starts)) - np.searchsorted(owners, owners)
    return words_in(data, np.append(starts, len(data))), owners, number


def _terms(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """What a word adds to the hash of a sequence that has it at a place."""
    return mix(hashes + _STEP * (places.astype(_U) + _U(1)))


def _running(terms: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, _U), np.cumsum(terms)])


class Lines:
    """Hashes of whole lines, of their halves, and of lines without one word."""

    def __init__(self, words: Words):
        self.words = words
        self.n = words.counts()
        self.begin, self.end = words.offsets[:-1], words.offsets[1:]
        h = words.hashes()
        place = np.arange(len(h)) - np.repeat(self.begin, self.n)
        from_end = np.repeat(self.n, self.n) - place
        self.forward = _running(_terms(h, place))
        self.shifted = _running(_terms(h, place - 1))
        self.backward = _running(_terms(h, from_end))

    def names(self, lines: np.ndarray) -> np.ndarray:
        b, e, n = self.begin[lines], self.end[lines], self.n[lines]
        return mix(self.forward[e] - self.forward[b] + _SIZE * n.astype(_U))

    def halves(self, lines: np.ndarray) -> np.ndarray:
        """Four keys a line: first and last half, against a partner as long or longer, and a shorter one."""
        b, e, n = self.begin[lines], self.end[lines], self.n[lines]
        keys = []
        for shorter in (n, n - 1):
            half, tag = shorter // 2, _SIZE * shorter.astype(_U)
            keys.append(mix(self.forward[b + half] - self.forward[b] + tag))
            keys.append(mix(self.backward[e] - self.backward[e - half] + tag + _SIDE))
        return np.stack(keys, 1) if len(lines) else np.zeros((0, 4), _U)

    def sketches(self, lines: np.ndarray, size: int) -> np.ndarray:
        """``size`` (a power of two) times 64 bits a line, each the parity of the words with that hash.

        An edit changes two of them at most.
        """
        b, n = self.begin[lines], self.n[lines]
        ends = np.cumsum(n)
        at = np.repeat(b - ends + n, n) + np.arange(n.sum())
        h = self.words.hashes()[at]
        bits, part = _U(1) << (h & _U(63)), h >> _U(6) & _U(size - 1)
        found = np.zeros((len(lines), size), _U)
        for k in range(size):
            run = np.concatenate([np.zeros(1, _U), np.bitwise_xor.accumulate(np.where(part == _U(k), bits, _U(0)))])
            found[:, k] = run[ends] ^ run[ends - n]
        return found

    def without(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The line, the place taken out, and the hash of what is left, for every word of the lines."""
        n = self.n[lines]
        owner = np.repeat(lines, n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        at = self.begin[owner] + place
        left = self.forward[at] - self.forward[self.begin[owner]]
        right = self.shifted[self.end[owner]] - self.shifted[at + 1]
        return owner, place, mix(left + right + _SIZE * (self.n[owner] - 1).astype(_U))


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """Whether two word sequences are equal or one word put in, taken out or replaced apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    first = next((i for i in range(short) if a[i] != b[i]), short)
    return a[first + (len(a) >= len(b)) :] == b[first + (len(b) >= len(a)) :]


def edits_between(a: list[str], b: list[str]) -> int:
    """The edit distance of two word sequences, a column of the table at once as the bits of an integer."""
    if not a or not b:
        return len(a) + len(b)
    full, top, at = (1 << len(a)) - 1, 1 << (len(a) - 1), {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    up, down, found = full, 0, len(a)
    for w in b:
        same = at.get(w, 0)
        level = (((same & up) + up) ^ up) | same
        more, less = (down | ~(level | up)) & full, up & level
        found += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & full, (less << 1) & full
        up, down = (less | ~(same | down | more)) & full, more & (same | down)
    return found


def within_growing_bound(a: list[str], b: list[str]) -> bool:
    """Whether two word sequences are at most one edit in ``EDIT_WORDS`` words of the longer one apart."""
    longer = max(len(a), len(b))
    most = longer // EDIT_WORDS
    # Each word of the longer one that the other lacks is an edit.
    return longer - (Counter(a) & Counter(b)).total() <= most and edits_between(a, b) <= most


def _settled(df: DataFrame, staging: Staging, name: str) -> DataFrame:
    """``df`` written, and its shuffle files gone: Spark deletes them when the driver's JVM collects its garbage."""
    written = staging.table(df, name)
    df.sparkSession.sparkContext._jvm.System.gc()
    return written


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _documents(df: DataFrame) -> DataFrame:
    return df.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"),
        F.xxhash64(text_of()).alias("mark"),
        text_of().alias("text"),
    )


def line_table(df: DataFrame, halves: bool, least: int = MIN_WORDS, sketch: bool = False) -> DataFrame:
    """``doc``, ``mark``, ``line`` and ``name`` of every line of ``least`` words, with half keys and a sketch if asked.

    Lines of less than ``MIN_WORDS`` words have no half keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 2):
            words, owners, number = _lines(batch.column(2))
            lines = Lines(words)
            long = np.flatnonzero(lines.n >= least)
            columns = [
                batch.column(0).take(pa.array(owners[long])),
                batch.column(1).take(pa.array(owners[long])),
                pa.array(number[long].astype(np.int32)),
                _signed(lines.names(long)),
            ]
            if halves:
                near = lines.n[long] >= MIN_WORDS
                offsets = np.concatenate([[0], np.cumsum(near * 4)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(offsets, _signed(lines.halves(long[near]).ravel())))
            if sketch:
                columns.append(_signed(lines.sketches(long, 1).ravel()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc", "mark", "line", "name"] + ["keys"] * halves + ["sketch"] * sketch
    schema = "doc long, mark long, line int, name long" + ", keys array<long>" * halves + ", sketch long" * sketch
    return _documents(df).mapInArrow(run, schema)


def _chosen(
    lines: Lines, owners: np.ndarray, number: np.ndarray, asked: pa.Array
) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a batch that are asked for, and the halves they share, as bits."""
    wanted = {(i, k >> 2): k & 3 for i, some in enumerate(asked.to_pylist()) for k in some}
    sides = np.array([wanted.get(x, -1) for x in zip(owners.tolist(), number.tolist())], np.int64)
    chosen = np.flatnonzero((lines.n >= MIN_WORDS) & (sides >= 0))
    return chosen, sides[chosen]


def _texts(lines: Lines, chosen: np.ndarray) -> list[str]:
    """The words of each line, with a space between."""
    words = lines.words
    return [
        b" ".join(words.bytes_at(w) for w in range(lines.begin[j], lines.end[j])).decode(errors="replace")
        for j in chosen
    ]


def _asked_documents(df: DataFrame, firsts: DataFrame, staging: Staging) -> DataFrame:
    """``text`` and ``asked`` of the documents that ``first`` names: four times a line's number, and its ``sides``."""
    sides = F.col("sides") if "sides" in firsts.columns else F.lit(0)
    line = F.shiftleft(F.col("first.line").cast("long"), 2).bitwiseOR(sides.cast("long"))
    asked = firsts.groupBy("first.doc", "first.mark").agg(F.collect_set(line).alias("asked"))
    asked = staging.table(asked, "asked")
    if asked.count() <= BROADCAST_IDS:
        asked = F.broadcast(asked)
    return _documents(df).join(asked, ["doc", "mark"])


def _marked(rows: np.ndarray) -> np.ndarray:
    """Rows of key, name and code of a batch by key and name, each once, with two bits after the code.

    They say whether the batch has other rows of the key as well, and whether one of them stands before.
    """
    rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
    key, name, code = rows[:, new]
    again = np.zeros(len(key), bool)
    again[1:] = key[1:] == key[:-1]
    met = again.copy()
    met[:-1] |= again[1:]
    return np.stack([key, name, code << _U(2) | met.astype(_U) << _U(1) | again.astype(_U)])


def _shared(rows: DataFrame) -> DataFrame:
    """``key``, ``name`` and ``code`` of marked rows (see ``_marked``) whose key others have, without the two bits.

    A key's rows meet in one task, a row per batch: the others of a batch are known to share it and
    go elsewhere by their names. So each key and name is shuffled once, and a hot key is spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row so far, which the next batch may have a partner for.
        held = np.zeros((3, 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], 1)
            kind = np.stack([rows[0], rows[1], rows[2] >> 2])
            at = np.flatnonzero(np.append(True, (kind[:, 1:] != kind[:, :-1]).any(0)))
            rows = np.concatenate([rows[:2, at], np.bitwise_or.reduceat(rows[2:], at, 1)])
            again = np.append(False, rows[0, 1:] == rows[0, :-1])
            rows[2] |= 2 * (again | np.append(again[1:], False))
            held, rows = rows[:, -1:], rows[:, :-1]
            yield out(rows)
        yield out(held)

    def out(rows: np.ndarray) -> pa.RecordBatch:
        key, name, code = rows[:, rows[2] & 2 > 0]
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(name), pa.array(code >> 2)], names=["key", "name", "code"])

    spare = F.col("code").bitwiseAND(1) == 1
    met = rows.repartition(F.when(spare, F.xxhash64("name")).otherwise(F.col("key")))
    return met.sortWithinPartitions("key", "name", "code").mapInArrow(run, "key long, name long, code long")


def _neighbourhoods(documents: DataFrame) -> DataFrame:
    """For the asked lines: themselves (``code`` 0, with their words) and themselves without each word (its place from 1).

    A line that shares its first half only has its edit in the rest, and the other way round. Codes are marked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 0):
            words, owners, number = _lines(batch.column(0))
            lines = Lines(words)
            chosen, sides = _chosen(lines, owners, number, batch.column(1))
            owner, place, variant = lines.without(chosen)
            n, shares = lines.n[owner], np.repeat(sides, lines.n[chosen])
            # Where the shorter one may be a word shorter, its half is the least that is known to be equal.
            first, last = place >= (n - 1) // 2, place < n - (n - 1) // 2
            told = ((shares & 1 > 0) & first) | ((shares & 2 > 0) & last)
            names = lines.names(chosen)
            rows = _marked(
                np.stack(
                    [
                        np.concatenate([names, variant[told]]),
                        np.concatenate([names, np.repeat(names, lines.n[chosen])[told]]),
                        np.concatenate([np.zeros(len(chosen), _U), place[told].astype(_U) + _U(1)]),
                    ]
                )
            )
            texts = dict(zip(names.tolist(), _texts(lines, chosen)))
            whole = rows[2] >> _U(2) == 0
            written = [texts[x] if w else None for x, w in zip(rows[1].tolist(), whole.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*map(_signed, rows), pa.array(written, pa.string())], names=["key", "name", "code", "words"]
            )

    return documents.select("text", "asked").mapInArrow(run, "key long, name long, code long, words string")


def _confirmed(
    links: DataFrame, texts: DataFrame, alike: Callable[[list[str], list[str]], bool] = within_one_edit
) -> DataFrame:
    """Links whose two lines really are near each other, by default one edit apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            good = [alike(a.split(" "), b.split(" ")) for a, b in zip(x, y)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good, pa.bool_()))], names=["name"])

    a = texts.select("name", F.col("words").alias("x"))
    b = texts.select(F.col("name").alias("other"), F.col("words").alias("y"))
    return links.join(a, "name").join(b, "other").select("name", "x", "y").mapInArrow(run, "name long")


def _logs(counts: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and their numbers ``n`` on a log scale."""
    h = counts[key].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], np.rint(16 * np.log2(1 + counts["n"].to_numpy())).astype(np.int64)[order]


def _looked_up(h: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each key, 0 where it is not among the ``known`` ones, which ascend."""
    if not len(known):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, values[at], 0)


_NO_LOGS = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _rare_pairs(
    h: np.ndarray, weight: np.ndarray, offsets: np.ndarray, hot: tuple[np.ndarray, np.ndarray] = _NO_LOGS
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each line the rarest neighbouring pairs of words that the edits to a line it may go with cannot all touch.

    To a line not longer, of n words these are a fifth of n. To a longer one they are a quarter at
    most, as its fifth is at most a quarter of n; each word that it has more touches a single
    pair, so one edit more than a fifth comes with the words up to the next multiple of five, and
    the further ones with five words each. With each pair its first and its last place in the line.
    Pairs that are ``hot`` come after all others, the hottest last.
    """
    n = np.diff(offsets)
    line = np.repeat(np.arange(len(n)), n)
    start = np.flatnonzero(line[:-1] == line[1:])
    value = mix(h[start] * _STEP + mix(h[start + 1]))
    order = np.lexsort((value, weight[start] + weight[start + 1], _looked_up(value, *hot), line[start]))
    value, place = value[order], (start[order] - offsets[line[start[order]]]).tolist()
    ends = np.searchsorted(line[start], np.arange(len(n) + 1))
    found = []
    for a, b, size in zip(ends[:-1].tolist(), ends[1:].tolist(), n.tolist()):
        fifth, most = size // EDIT_WORDS, size // (EDIT_WORDS - 1)
        # Pairs that an edit more can touch, some of which each take a single one.
        touched = 2 * (fifth + 1) - (EDIT_WORDS - size % EDIT_WORDS)
        # An edit touches two pairs at most, and only neighbours: a run of r pairs takes (r + 1) // 2.
        runs: dict[int, int] = {}
        used, edits = a, 0
        while used < b and edits <= most and (edits <= fifth or used - a <= touched):
            p = place[used]
            left, right = runs.get(p - 1, 0), runs.get(p + 1, 0)
            run = left + 1 + right
            edits += (run + 1) // 2 - (left + 1) // 2 - (right + 1) // 2
            runs[p] = runs[p - left] = runs[p + right] = run
            used += 1
        # All places of the last pair, so that what is taken depends on the pair only.
        while a < used < b and value[used] == value[used - 1]:
            used += 1
        # By weight, then by value, so the places of a pair are neighbours.
        at = np.flatnonzero(np.append(True, value[a + 1 : used] != value[a : used - 1]))
        places = np.array(place[a:used], np.int64)
        found.append((value[a:used][at], np.minimum.reduceat(places, at), np.maximum.reduceat(places, at)))
    return found


def _word_weights(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent words of a sample, ascending, and how frequent they are on a log scale."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 0):
            words, _, _ = _lines(batch.column(0))
            h, n = np.unique(words.hashes(), return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(h), pa.array(n.astype(np.int64))], names=["word", "n"])

    counts = df.select(text_of().alias("text")).limit(SAMPLE_TEXTS).mapInArrow(run, "word long, n long")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(SAMPLE_WORDS).toArrow()
    return _logs(top, "word")


def _pair_rows(
    df: DataFrame,
    weights: tuple[np.ndarray, np.ndarray] | None = None,
    hot: tuple[np.ndarray, np.ndarray] = _NO_LOGS,
    asked: bool = False,
) -> DataFrame:
    """``pair``, ``name`` and ``code`` of the rare pairs of lines that may be two edits from another.

    All lines, or those ``asked`` for in a column of that name. ``code`` has, from its high bits on, the words of the line and the first and the last place of the
    pair, and is marked.
    """
    shared = df.sparkSession.sparkContext.broadcast((weights or _word_weights(df), hot))

    def of_piece(piece: pa.RecordBatch) -> np.ndarray:
        frequent, hottest = shared.value
        words, owners, number = _lines(piece.column(0))
        lines = Lines(words)
        # The longer has twice EDIT_WORDS, the shorter two words less.
        chosen = np.flatnonzero(lines.n >= 2 * EDIT_WORDS - 2)
        if asked:
            chosen = np.intersect1d(chosen, _chosen(lines, owners, number, piece.column(1))[0])
        name, first = np.unique(lines.names(chosen), return_index=True)
        chosen = np.sort(chosen[first])
        name = lines.names(chosen)
        h = words.hashes()
        weight = _looked_up(h, *frequent)
        wanted = np.zeros(len(lines.n), bool)
        wanted[chosen] = True
        inside = np.repeat(wanted, lines.n)
        offsets = np.concatenate([[0], np.cumsum(lines.n[chosen])])
        pairs = _rare_pairs(h[inside], weight[inside], offsets, hottest)
        line = np.repeat(np.arange(len(chosen)), [len(x) for x, _, _ in pairs])
        pair = np.concatenate([np.zeros(0, _U), *(x for x, _, _ in pairs)])
        places = [np.concatenate([np.zeros(0, np.int64), *(x[i] for x in pairs)]) for i in (1, 2)]
        code = np.minimum(lines.n[chosen][line], MOST_WORDS)
        for x in places:
            code = code << 20 | np.minimum(x, MOST_PLACE)
        return np.stack([pair, name[line], code.astype(_U)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([np.zeros((3, 0), _U), *map(of_piece, _pieces(iter([batch]), 0))], 1)
            # A line that several pieces have has the same rows in each.
            yield pa.RecordBatch.from_arrays([*map(_signed, _marked(found))], names=["pair", "name", "code"])

    rows = df.select("text", "asked") if asked else df.select(text_of().alias("text"))
    return rows.mapInArrow(run, "pair long, name long, code long")


def _words_table(documents: DataFrame) -> DataFrame:
    """``name``, number ``n`` of words, sketch ``bits`` and ``words`` of the asked lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 0):
            words, owners, number = _lines(batch.column(0))
            lines = Lines(words)
            chosen, _ = _chosen(lines, owners, number, batch.column(1))
            offsets = np.arange(len(chosen) + 1, dtype=np.int32) * SKETCH_LONGS
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(lines.names(chosen)),
                    pa.array(lines.n[chosen].astype(np.int64)),
                    pa.ListArray.from_arrays(offsets, _signed(lines.sketches(chosen, SKETCH_LONGS).ravel())),
                    pa.array(_texts(lines, chosen), pa.string()),
                ],
                names=["name", "n", "bits", "words"],
            )

    return documents.select("text", "asked").mapInArrow(run, "name long, n long, bits array<long>, words string")


def _farther(df: DataFrame, kinds: DataFrame, near: DataFrame, staging: Staging) -> DataFrame:
    """``name`` of lines not in ``near`` that the growing bound allows an earlier line for.

    Lines are told by their rank in order of place, which is one number.
    """
    with staging.inner() as own:
        return _farther_in(own, df, kinds, near, staging)


def _farther_in(own: Staging, df: DataFrame, kinds: DataFrame, near: DataFrame, staging: Staging) -> DataFrame:
    ranks = kinds.select("name", "first", "sketch").orderBy("first").withColumn("rank", F.monotonically_increasing_id())
    ranks = _settled(ranks, own, "ranks")
    weights = _word_weights(df)

    def spread_by(pairs: DataFrame, told: DataFrame) -> DataFrame:
        with staging.inner() as part:
            rows = _settled(_shared(pairs.withColumnRenamed("pair", "key")), part, "pairs")
            spread = rows.join(told, "name").select(
                "key", "rank", "code", "sketch", F.coalesce("gone", F.lit(False)).alias("gone")
            )
            return _settled(spread, own, "spread")

    told = ranks.join(near.withColumn("gone", F.lit(True)), "name", "left")
    spread = spread_by(_pair_rows(df, weights), told)
    line = F.struct("rank", "code", "sketch")
    leads = _settled(spread.groupBy("key").agg(F.min(line).alias("lead")), own, "leads")

    def parts(side: str) -> list[Column]:
        code = F.col(f"{side}code")
        low, high = (F.shiftright(code, k).bitwiseAND(MOST_PLACE) for k in (20, 0))
        return [F.shiftright(code, 40), low, F.when(high == MOST_PLACE, 2**30).otherwise(high)]

    (n, low, high), (of_n, of_low, of_high) = parts(""), parts("lead.")
    longer = F.greatest(n, of_n)
    most = F.floor(longer / EDIT_WORDS)
    # If the pair is what edits leave alone, they make up for the words that one has more of before and after it.
    before = F.greatest(F.lit(0), low - of_high, of_low - high)
    after = F.greatest(F.lit(0), n - high - of_n + of_low, of_n - of_high - n + low)
    fits = (F.abs(n - of_n) <= most) & (before + after <= most)
    # A word put in or taken out is one bit and one word more or less, a replaced one two bits.
    alike = F.bit_count(F.col("sketch").bitwiseXOR(F.col("lead.sketch"))) + F.abs(n - of_n) <= 2 * most
    allowed = (F.col("lead.rank") < F.col("rank")) & (most > EDITS) & ((fits & alike) | (longer >= MOST_WORDS))
    # Both lines have the same pair before this one, as far off, so they have met there.
    met = (F.col("before") == F.col("lead.before")) & (F.col("gap") == F.col("lead.gap"))

    def differing(a: str, b: str) -> Column:
        return sum(F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(SKETCH_LONGS))

    alike_in_wide = (differing("bits", "lead.bits") + F.abs(n - of_n) <= 2 * most) | (longer >= MOST_WORDS)
    of_other = [F.col("n").alias("other_n"), F.col("bits").alias("other_bits")]
    apart = differing("bits", "other_bits") + F.abs(F.col("n") - F.col("other_n"))
    alike_in_all = apart <= 2 * F.floor(F.greatest("n", "other_n") / EDIT_WORDS)

    def links_of(rows: DataFrame, leads: DataFrame, bound: Column = allowed) -> DataFrame:
        links = rows.join(leads, "key").filter(bound).select("rank", F.col("lead.rank").alias("other"))
        return _settled(links.distinct(), own, "links")

    def found(links: DataFrame) -> DataFrame:
        with staging.inner() as part:
            asked = links.select("rank").union(links.select("other")).distinct()
            asked = _settled(ranks.join(asked, "rank").select("rank", "name", "first"), part, "linked")
            name = asked.select("rank", "name")
            named = links.join(name, "rank").select("name", F.col("other").alias("rank"))
            named = named.join(name.withColumnRenamed("name", "other"), "rank").select("name", "other")
            texts = part.table(_words_table(_asked_documents(df, asked, part)), "words").dropDuplicates(["name"])
            bits = texts.select("name", "n", "bits")
            close = named.join(bits, "name").join(bits.select(F.col("name").alias("other"), *of_other), "other")
            close = _settled(close.filter(alike_in_all).select("name", "other"), part, "close")
            compared = close.select("name").union(close.select("other")).distinct()
            alike = _confirmed(close, texts.join(compared, "name", "left_semi"), within_growing_bound).distinct()
            return _settled(alike, staging, "near")

    first = found(links_of(spread.filter("NOT gone"), leads))
    settled = ranks.join(first, "name").select("rank")
    links, hot = [], _NO_LOGS
    for turn in range(TURNS + 1):
        sizes = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_LINES)
        hottest = most_frequent(own.table(sizes, "sizes"), "n", HOT_PAIRS)
        keys, counts = _logs(hottest.toArrow(), "key")
        new = ~np.isin(keys, hot[0])
        last = turn == TURNS or not new.any()
        # Lines that share a pair that is not hot meet in it. Those that share hot ones only are all told again.
        here = spread if last else spread.join(F.broadcast(hottest.select("key")), "key", "left_anti")
        bound, told_by = allowed, ["rank", "code", "sketch"]
        if last and turn:
            wide = _words_table(_asked_documents(df, told, own)).select("name", "bits").dropDuplicates(["name"])
            wide = own.table(told.select("name", "rank").join(wide, "name").drop("name"), "bits")
            by_heat = Window.partitionBy("rank").orderBy(F.desc("n"), "key")
            gap = F.col("place") - F.lag("place").over(by_heat)
            here = here.join(F.broadcast(hottest), "key", "left").withColumn("place", F.when(low == high, low))
            here = here.join(wide, "rank").withColumns({"before": F.lag("key").over(by_heat), "gap": gap})
            here = _settled(here.drop("n", "place"), own, "wide")
            bound = allowed & alike_in_wide & ~F.coalesce(met, F.lit(False))
            told_by += ["bits", "before", "gap"]
        left = here.filter("NOT gone").join(settled, "rank", "left_anti")
        links.append(links_of(left, here.select("key", F.struct(*told_by).alias("lead")), bound))
        if last:
            break
        at = np.argsort(np.append(hot[0], keys[new]))
        hot = np.append(hot[0], keys[new])[at], np.append(hot[1], counts[new])[at]
        again = spread.join(F.broadcast(hottest.select("key")), "key", "left_semi").select("rank").distinct()
        told = own.table(told.join(again, "rank"), "told")
        spread = spread_by(_pair_rows(_asked_documents(df, told, own), weights, hot, asked=True), told)
    return first.union(found(reduce(DataFrame.union, links).distinct()))


def _one_edit_apart(df: DataFrame, kinds: DataFrame, part: Staging, staging: Staging) -> DataFrame:
    """``name`` of lines that are one edit from an earlier one."""
    # Lines that share a half with a different line; the other lines are alone.
    halves = kinds.select("name", F.posexplode("keys").alias("at", "key"))
    shared = halves.groupBy("key").agg(F.min("name").alias("a"), F.max("name").alias("b")).filter("a < b")
    side = F.when(F.col("at") % 2 == 0, 1).otherwise(2)
    possible = halves.join(shared.select("key"), "key", "left_semi").groupBy("name").agg(F.bit_or(side).alias("sides"))
    possible = _settled(kinds.select("name", "first").join(possible, "name"), part, "possible")
    around = part.table(_neighbourhoods(_asked_documents(df, possible, part)), "around")
    texts = around.filter("words IS NOT NULL").select("name", "words").dropDuplicates(["name"])
    firsts = possible.select("name", F.struct("first", "name").alias("order"))
    around = _settled(_shared(around.select("key", "name", "code")).join(firsts, "name"), part, "met")
    whole = around.filter("code = 0").select("name", "order")
    cut = around.filter("code > 0").select(F.col("key").alias("variant"), F.col("code").alias("place"), "name", "order")
    earliest = cut.groupBy("variant", "place").agg(F.min("order").alias("lead"))
    # Replaced: both are equal without the word at one place.
    replaced = cut.join(earliest, ["variant", "place"]).select("name", "order", "lead")
    # Put in: what is left of a later line is an earlier one; taken out: the other way round.
    longer = cut.join(whole.select(F.col("name").alias("variant"), F.col("order").alias("lead")), "variant").select(
        "name", "order", "lead"
    )
    least = earliest.groupBy("variant").agg(F.min("lead").alias("lead"))
    shorter = whole.join(least, whole["name"] == least["variant"]).select("name", "order", "lead")
    links = (
        replaced.union(longer)
        .union(shorter)
        .filter("lead < order")
        .select("name", F.col("lead.name").alias("other"))
        .distinct()
    )
    return _settled(_confirmed(part.table(links, "links"), texts).distinct(), staging, "near")


def removed_lines(df: DataFrame, staging: Staging, least: int = MIN_WORDS, grow: bool = False) -> DataFrame:
    """``doc``, ``mark`` and ``line`` of the lines that go: equal to, or one edit from, an earlier one.

    Lines of ``least`` words to less than ``MIN_WORDS`` go only if they are equal to one. With ``grow``
    a line of n words goes if it is at most n / ``EDIT_WORDS`` edits from an earlier one, n of the longer.
    """
    lines = staging.table(line_table(df, halves=True, least=least, sketch=grow), "lines")
    place = F.struct("doc", "mark", "line")
    told = ["keys", "sketch"] if grow else ["keys"]
    kinds = lines.groupBy("name").agg(
        F.min(place).alias("first"), F.max(place).alias("last"), *[F.any_value(c).alias(c) for c in told]
    )
    kinds = _settled(kinds, staging, "kinds")
    with staging.inner() as part:
        near = _one_edit_apart(df, kinds, part, staging)
    if grow:
        near = near.union(_farther(df, kinds, near, staging))
    flagged = (
        kinds.select("name", "first", "last")
        .join(near.withColumn("near", F.lit(True)), "name", "left")
        .filter("near or first < last")
        .select("name", "first", F.coalesce("near", F.lit(False)).alias("near"))
    )
    return lines.join(flagged, "name").filter(F.col("near") | (place > F.col("first"))).select("doc", "mark", "line")


def dedup_lines(
    df: DataFrame,
    staging: Staging,
    n_lines: str = "n_lines",
    n_removed: str = "n_removed",
    least: int = MIN_WORDS,
    grow: bool = False,
) -> DataFrame:
    """``df`` with the text of each row without its repeated lines, and how many it had and lost.

    Lines are joined again by line feeds; blank lines and those under ``least`` words stay. Rows whose
    every word went keep an empty text: dropping them is the caller's choice.
    Null texts stay null. A null ``doc_id`` counts as the last. Rows alike in id
    and text keep or lose the same lines. The two counts replace columns of their
    names; all others pass through.
    """
    doc, mark, gone, parts = free_name(df, "__doc", "__mark", "__gone", "__parts")
    removed = (
        removed_lines(df, staging, least, grow)
        .groupBy(F.col("doc").alias(doc), F.col("mark").alias(mark))
        .agg(F.collect_set("line").alias(gone))
    )
    keyed = df.withColumns(
        {doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), mark: F.xxhash64(text_of())}
    )
    joined = keyed.join(removed, [doc, mark], "left").withColumn(parts, F.split(text_of(), "\n", -1))
    size = F.size(parts)
    left = F.array_except(F.sequence(F.lit(0), size - 1), F.col(gone))
    rest = F.array_join(F.transform(left, lambda i: F.get(F.col(parts), i)), "\n")
    # Nothing but white space left is nothing left.
    rest = F.when(rest.rlike(_WORD_CHARACTER), rest).otherwise("")
    return joined.select(
        *[
            (F.when(F.col(gone).isNotNull(), rest).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c))
            for c in df.columns
            if c not in (n_lines, n_removed)
        ],
        F.when(F.col("text").isNull(), 0).otherwise(size).cast("long").alias(n_lines),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_removed),
    )


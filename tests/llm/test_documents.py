"""Fingerprints, quality rules, line dedup, near duplicates, mixing and scores against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from corpus_fixture import SCHEMA, messy_rows
from pyspark.sql import functions as F

from quotelens.llm import dart_minhash, fingerprints, lattice, line_dedup, mixing, quality
from quotelens.llm.common import WORD, shingles_of, words_of
from quotelens.sources import Staging

WORDS = "the of and to in is that it for was on with as be by this are at from over under".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(("", "", "x", "yz")) + str(rnd.randrange(30)) for _ in range(n))


def shingle_set(text):
    w = re.findall(WORD, text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


# --- fingerprints ---------------------------------------------------------------


def test_edited_texts_follow_the_descending_order(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 5)
    rnd = random.Random(3)
    rows = [(i * 3 - 40, prose(rnd, rnd.choice((0, 1, 3, 30, 200)))) for i in range(60)]
    rnd.shuffle(rows)
    out = fingerprints.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    found = {r.doc_id: r for r in out.collect()}
    ordered = sorted(rows, reverse=True)
    assert len(found) == len(rows)
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingle_set(text), shingle_set(edited)
        if len(a) > 150:
            assert abs(r.near_edited - len(a & b) / len(a)) < 0.35
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_frequent_ids_are_cut_by_their_texts(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 4)
    rnd = random.Random(4)
    ids = [None] * 40 + [7] * 30 + [9] * 9 + [*range(20), *(2**60 + rnd.randrange(300) for _ in range(40))]
    rows = [(i, prose(rnd, rnd.choice((0, 3, 30)))) for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    # The largest bucket has no more than a few times BUCKET_ROWS distinct rows.
    cuts = fingerprints._cuts(
        df.select(fingerprints._order_key(F.col("doc_id")).alias("key"), "text"), np.array([-(2**63), 3, 7, 2**61]), np.array([10, 1, 8, 1])
    )
    assert set(cuts) == {-(2**63), 7} and len(cuts[7]) > 4
    numbered = df.withColumn("rank", F.xxhash64("text")).collect()
    ordered = sorted(numbered, key=lambda r: (-(2**63) if r.doc_id is None else r.doc_id, ~r.rank), reverse=True)
    expected = []
    for k, r in enumerate(ordered):
        text, following = r.text, ordered[(k + 1) % len(ordered)].text
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        expected.append((str(r.doc_id), len(text), hashlib.sha256(edited.encode()).hexdigest()))
    out = fingerprints.edited_likeness(df).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in out) == sorted(expected)


def test_fingerprints_of_messy_rows(messy, nothing):
    out = fingerprints.edited_likeness(messy).collect()
    assert len(out) == len(messy_rows()) and sum(r.doc_id is None for r in out) == 2
    by_text = {(r.doc_id, r.n_chars): r.fingerprint for r in out}
    assert by_text[1, len(messy_rows()[0][1])] == by_text[2, len(messy_rows()[0][1])]
    assert by_text[3, 0] == by_text[4, 0] == ""
    assert fingerprints.edited_likeness(nothing).count() == 0


def test_an_only_document_is_its_own_next(spark):
    (r,) = fingerprints.edited_likeness(spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"a b c a b c").hexdigest()


def test_sketches_merge_and_estimate_containment(spark):
    rnd = random.Random(5)
    a, b = prose(rnd, 4000), prose(rnd, 400)
    both = a + " " + b
    x, y, z = fingerprints.sketches(shingles_of(words_of(pa.array([a, b, both]))), 3)
    assert abs(fingerprints.containment(y, z) - 1) < 0.1 and fingerprints.containment(z, y) < 0.2
    assert fingerprints.containment(x, y) < 0.05
    merged = fingerprints.merge([x, y])
    assert len(np.setdiff1d(z, merged)) <= 4
    df = spark.createDataFrame([(1, a), (1, b), (2, None)], "g int, text string")
    found = fingerprints.merge_fingerprints(fingerprints.fingerprint_documents(df), ["g"]).collect()
    assert {r.g: r.fingerprint for r in found} == {1: fingerprints.encode(merged), 2: ""}
    assert fingerprints.containment(x[:0], x[:0]) == 1 and fingerprints.containment(x[:0], x) == 0


def test_likeness_comes_from_the_two_fingerprints(spark):
    rnd = random.Random(13)
    rows = []
    for i, n in enumerate((5, 6, 8, 10, 10, 12, 20, 40, 60, 68, 90, 150, 400)):
        short = prose(rnd, n)
        rows += [(4 * i + 3, short), (4 * i + 2, prose(rnd, 300) + " " + short + " " + prose(rnd, 300)), (4 * i + 1, prose(rnd, n)), (4 * i, prose(rnd, 600))]
    rows += [(-1, ""), (-2, None), (-3, "one"), (-4, "one")]
    found = {r.doc_id: r for r in fingerprints.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = {i: text or "" for i, text in rows}
    order = sorted(texts, reverse=True)
    for i, after in zip(order, [*order[1:], order[0]]):
        r = found[i]
        ours, edited, following = (
            fingerprints.decode(f) for f in (r.fingerprint, r.edited_fingerprint, found[after].fingerprint)
        )
        for near, alike, other in ((r.near_edited, r.jaccard_edited, edited), (r.near_next, r.jaccard_next, following)):
            told = fingerprints.containment(ours, other)
            assert near == (0 if math.isnan(told) else told) and alike == fingerprints.jaccard(ours, other)
        a, b = shingle_set(texts[i]), shingle_set(texts[after])
        if max(len(a), len(b)) < fingerprints.LOWEST and a:
            # Both are whole: exact.
            assert r.near_next == len(a & b) / len(a) and r.jaccard_next == len(a & b) / len(a | b)
        elif i % 4 == 3 and i > 0 and len(a) > 5:
            assert r.near_next == 1
    assert found[-3].near_next == found[-1].near_next == 1 and found[-2].near_next == 0


def test_texts_whose_hashes_lie_beyond_the_other_sketch_are_unknown():
    rnd = random.Random(14)
    shorts = [prose(rnd, 6) for _ in range(40)]
    found = fingerprints.sketches(shingles_of(words_of(pa.array([*shorts, " ".join(shorts)]))), 41)
    reach = max(fingerprints.threshold(), found[40][-1])
    for x in found[:40]:
        assert len(x) == 2
        unknown = x[0] > reach
        assert math.isnan(fingerprints.containment(x, found[40])) == unknown
        assert unknown or fingerprints.containment(x, found[40]) == 1
        assert fingerprints.containment(x, x) == 1 == fingerprints.jaccard(x, x)


# --- quality ----------------------------------------------------------------------


def test_quality_counts_by_brute_force(messy, nothing):
    rows = quality.judge_documents(messy).collect()
    assert len(rows) == len(messy_rows())
    for r in rows:
        text = r.text or ""
        w = re.findall(WORD, text)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if re.search(WORD, x)]
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == len(covered)
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.kept and r.base_failed) and r["__text"] == "clash"
    assert quality.judge_documents(nothing).count() == 0


def test_junk_goes_and_prose_stays(spark):
    rnd = random.Random(9)
    clean = [" ".join(rnd.choice(WORDS + ["house", "rivers", "walking", "greener"] * 8) for _ in range(200)) + "." for _ in range(40)]
    junk = [clean[0].upper().replace(" ", "!! "), clean[1].replace(" ", "### "), "".join(rnd.choice("0123456789abcdef ") for _ in range(900))]
    rows = [(i, t, "en") for i, t in enumerate(clean + junk)]
    out = quality.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in out.filter("kept").collect()}
    assert kept == set(range(len(clean)))
    assert out.filter("not base_failed").count() == len(rows)


def test_quality_runs_no_python(messy):
    text = quality.judge_documents(messy)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


# --- lines --------------------------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_removed(rows):
    """(doc_id, line) of lines with an earlier one equal to them or one word apart."""
    lines = []
    for i, text in sorted(rows):
        lines += [(i, k, re.findall(WORD, x)) for k, x in enumerate((text or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= line_dedup.MIN_WORDS]
    return {
        (i, k) for n, (i, k, w) in enumerate(lines) if any(edit_distance(w, v) <= 1 for _, _, v in lines[:n])
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_all_pairs(spark, stage, seed):
    rnd = random.Random(seed)
    base = [[rnd.choice(WORDS[:6]) for _ in range(rnd.randint(3, 9))] for _ in range(25)]
    rows = []
    for i in range(60):
        found = []
        for _ in range(rnd.randint(0, 4)):
            w = list(rnd.choice(base))
            for _ in range(rnd.choice((0, 0, 1, 1, 2))):
                k, p = rnd.choice("dis"), rnd.randrange(len(w) + 1)
                w[p : p + (k != "i")] = [] if k == "d" else [rnd.choice(WORDS)]
            found.append((" " if rnd.random() < 0.8 else "  ").join(w))
        rows.append((i, "\n".join(found)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    gone = {(r.doc, r.line) for r in line_dedup.removed_lines(df, stage).collect()}
    assert gone == brute_removed(rows) and len(gone) > 20
    for r in line_dedup.dedup_lines(df, stage).collect():
        left = [x for k, x in enumerate(dict(rows)[r.doc_id].split("\n")) if (r.doc_id, k) not in gone]
        text = "\n".join(left)
        assert r.text == (text if re.search(WORD, text) or not r.n_removed else "")


def test_line_dedup_of_messy_rows(messy, nothing, stage, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_IDS", 0)
    out = line_dedup.dedup_lines(messy, stage).collect()
    assert len(out) == len(messy_rows())
    assert [r.text for r in out if r.doc_id == 2] == ["", ""]
    assert {r.text for r in out if r.doc_id == 3} == {None}
    assert line_dedup.dedup_lines(nothing, stage).count() == 0


def test_short_lines_go_if_equal(spark, stage):
    rows = [(1, "All rights reserved.\n\nRead on"), (2, "Read on\n\nall rights reserved.\nHome"), (3, "Home\nAll  rights reserved.\nmore")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), stage, least=1).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in out} == {
        1: (rows[0][1], 0),
        2: ("\nall rights reserved.\nHome", 1),
        3: ("more", 2),
    }


def test_lines_one_word_in_five_apart_equal_all_pairs(spark, stage):
    rnd = random.Random(12)
    base = [[rnd.choice(WORDS) for _ in range(n)] for n in (8, 8, 9, 10, 10, 11, 12, 15, 16, 20, 31, 60) * 3]
    rows = []
    for i in range(70):
        found = []
        for _ in range(rnd.randint(0, 4)):
            w = list(rnd.choice(base))
            for _ in range(rnd.randrange(2 + len(w) // 4)):
                k, p = rnd.choice("dis"), rnd.randrange(len(w) + 1)
                w[p : p + (k != "i")] = [] if k == "d" else [rnd.choice(WORDS)]
            found.append(" ".join(w))
        rows.append((i, "\n".join(found)))
    lines = [(i, k, x.split()) for i, text in rows for k, x in enumerate(text.split("\n"))]
    near = lambda a, b: edit_distance(a, b) <= max(1, max(len(a), len(b)) // 5)
    expected = {
        (i, k) for n, (i, k, w) in enumerate(lines) if len(w) >= 5 and any(len(v) >= 5 and near(w, v) for _, _, v in lines[:n])
    }
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    gone = {(r.doc, r.line) for r in line_dedup.removed_lines(df, stage, grow=True).collect()}
    assert gone == expected and len(gone - brute_removed(rows)) > 10


def test_edits_between_is_the_edit_distance():
    rnd = random.Random(2)
    for _ in range(300):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randrange(12))] for _ in range(2))
        assert line_dedup.edits_between(a, b) == edit_distance(a, b)


def test_pipeline_removes_short_repeats(spark):
    import corpus_pipeline

    rows = [(i, "All rights reserved.\nonly text %d" % i, "en", "a", 33) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.repeated_lines(spark, docs, "").collect()
    assert {r.doc_id: r.text for r in out} == {0: rows[0][1], 1: "only text 1", 2: "only text 2"}


def test_within_one_edit_is_the_edit_distance():
    words = [list(x) for n in range(5) for x in itertools.product("ab", repeat=n)]
    for a, b in itertools.product(words, words):
        assert line_dedup.within_one_edit(a, b) == (edit_distance(a, b) <= 1)


# --- near duplicates ------------------------------------------------------------------


def brute_classes(rows):
    sets = [(i, shingle_set(t), re.findall(WORD, t or "")) for i, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x, y in itertools.combinations(range(len(rows)), 2):
        a, b = sets[x][1], sets[y][1]
        if a and b and len(a & b) >= 0.8 * len(a | b) and None not in (rows[x][0], rows[y][0]):
            parent[max(root(x), root(y), key=lambda k: rows[k][0])] = min(root(x), root(y), key=lambda k: rows[k][0])
    return sorted((i, rows[root(k)][0]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("by_count", [False, True])
def test_near_duplicates_equal_all_pairs(spark, stage, by_count):
    rnd = random.Random(11)
    rows, n = [], itertools.count()
    for size in (1,) * 20 + (2,) * 8 + (5, 40):
        w = prose(rnd, rnd.randint(6, 120)).split()
        for _ in range(size):
            v = list(w)
            for _ in range(rnd.randrange(1 + len(w) // 25)):
                v[rnd.randrange(len(v))] = rnd.choice(WORDS) + "new" + str(rnd.randrange(99))
            rows.append((next(n), " ".join(v)))
    rows += [(next(n), rows[3][1]) for _ in range(30)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = dart_minhash.near_duplicate_classes(df, stage, by_count)
    assert sorted((r.doc_id, r.class_id) for r in found.collect()) == brute_classes(rows)
    kept = {r.doc_id for r in dart_minhash.drop_near_duplicates(df, stage, by_count).collect()}
    assert kept == {c for _, c in brute_classes(rows)}


def test_families_of_one_base_equal_all_pairs(spark, stage, monkeypatch):
    """Copies with edits in common are similar to each other and not to what leads them."""
    rnd, rows = random.Random(5), []

    def edited(words, times):
        words = list(words)
        for _ in range(times):
            p = rnd.randrange(len(words))
            words[p : p + 1] = rnd.choice(([], ["new" + str(rnd.randrange(400))], [words[p], "more"]))
        return words

    base = prose(rnd, 90).split()
    for family in range(14):
        w = edited(base, rnd.randrange(9))
        rows += [(len(rows) + k, " ".join(edited(w, rnd.randrange(4)))) for k in range(rnd.choice((1, 5, 12)))]
    asked, compared = [], dart_minhash._other_candidates
    monkeypatch.setattr(dart_minhash, "_other_candidates", lambda *a: asked.append(compared(*a).cache()) or asked[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = dart_minhash.near_duplicate_classes(df, stage).collect()
    assert sorted((r.doc_id, r.class_id) for r in found) == brute_classes(rows)
    # Many pairs are similar there, and few of those that are not are looked at.
    assert 0 < asked[0].count() < len(rows) ** 2 // 20
    asked[0].unpersist()


def test_near_duplicates_of_messy_rows(messy, nothing, stage):
    kept = dart_minhash.drop_near_duplicates(messy, stage)
    assert kept.columns == messy.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    expected = [r for r in messy_rows() if r[0] != 2]
    assert ids == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in expected)
    assert dart_minhash.drop_near_duplicates(nothing, stage).count() == 0


def test_signatures_agree_as_often_as_texts_are_alike():
    rnd = random.Random(2)
    shared, left, right = (prose(rnd, n).split() for n in (300, 100, 100))
    texts = pa.array([" ".join(shared + left), " ".join(shared + right), "one two", ""])
    found = shingles_of(words_of(texts))
    for by_count in (False, True):
        s = dart_minhash.dart_signatures(*dart_minhash.weighted(found.values, found.texts, by_count), 4, k=2000)
        a, b = shingle_set(texts[0].as_py()), shingle_set(texts[1].as_py())
        assert abs((s[0] == s[1]).mean() - len(a & b) / len(a | b)) < 0.05
        assert (s[0] == s[2]).mean() < 0.01 and (s[:3] != 0).all() and not s[3].any()


def test_dart_signatures_follow_weights():
    values, k = np.array([1, 2], np.uint64), 4000
    one = dart_minhash.dart_signatures(values, np.array([0, 0]), np.array([1, 9]), 1, k)
    two = dart_minhash.dart_signatures(values, np.array([0, 0]), np.array([1, 1]), 1, k)
    assert abs((one == two).mean() - 2 / 10) < 0.03


def test_components_are_those_of_union_find(spark, stage):
    rnd = random.Random(4)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(500, 560)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    found = dart_minhash.components(spark.createDataFrame(edges, "a long, b long"), stage).collect()
    assert {r.name: r.root for r in found} == {x: root(x) for x in parent if root(x) != x}


# --- mixing ------------------------------------------------------------------------------


def test_mix_meets_given_targets(spark, stage):
    rnd = random.Random(6)
    rows = [(i, prose(rnd, rnd.choice((20, 150, 1200))), rnd.choice(("en", "de")), rnd.choice("aaab")) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cells = df.select("source", "lang", F.lit("t").alias("topic"), mixing.n_tokens_of(F.col("text")).alias("tokens"))
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.7, "de": 0.3}}
    raked = mixing.raked_cells(cells, stage, targets=targets, sweeps=12).collect()
    whole = sum(r.weight for r in raked)
    assert math.isclose(whole, sum(r.tokens for r in raked), rel_tol=1e-9)
    for margin, shares in targets.items():
        for value, share in shares.items():
            assert abs(sum(r.weight for r in raked if r[margin] == value) / whole - share) < 1e-6
    assert abs(sum(r.tokens * r.probability for r in raked) / whole - mixing.KEEP) < 1e-3
    out = mixing.mix_documents(df, stage, targets=targets).collect()
    expected = sum(r.n_tokens * r.probability for r in out)
    assert abs(sum(r.n_tokens for r in out if r.sampled) / expected - 1) < 0.15


def test_mix_of_messy_rows(messy, nothing, stage):
    out = mixing.mix_documents(messy, stage).collect()
    assert len(out) == len(messy_rows())
    assert all(not r.sampled and r.probability == 0 for r in out if not r.n_tokens)
    assert len({r.sampled for r in out if r.doc_id == 2}) == 1
    assert mixing.mix_documents(nothing, stage).count() == 0


INNER = (
    "__of __chars_of __common_of __probability __draw __tokens __source __lang __topic "
    "topic n_tokens probability sampled kept n_words base_failed own_topic"
).split()


def test_inner_names_and_columns_of_ones_own_pass_through(spark, messy, stage):
    """Every inner name as a column of the input; the pipeline's stages keep columns of their outputs' names."""
    import corpus_pipeline

    own = messy.select("doc_id", "text", "lang", "source", "n_chars").withColumns({c: F.lit(f"own {c}") for c in INNER})
    for out, added in ((quality.judge_documents(own), quality.ADDED), (mixing.mix_documents(own, stage), mixing.ADDED)):
        assert set(out.columns) == {*own.columns, *added}
        for r in out.collect():
            assert all(r[c] == f"own {c}" for c in INNER if c not in added)
    long = own.filter("length(text) > 40")
    for run in (corpus_pipeline.quality_rules, corpus_pipeline.mix):
        out = run(spark, long, "")
        assert out.columns == own.columns
        assert all(r[c] == f"own {c}" for r in out.collect() for c in INNER)


# --- lattice -----------------------------------------------------------------------------


def all_spellings(word, pieces):
    if not word:
        return 1.0
    return sum(p * all_spellings(word[len(x) :], pieces) for x, p in pieces.items() if word.startswith(x))


def test_lattice_sums_every_segmentation(monkeypatch):
    pieces = {b" a": 0.1, b" ": 0.05, b"a": 0.2, b"b": 0.1, b"ab": 0.15, b"aab": 0.05, b"bb": 0.02}
    vocabulary = lattice.Vocabulary(list(pieces), np.log(list(pieces.values())))
    words = [b"a", b"ab", b"aabb", b"abab", b"bbbaab", b"c"]
    expected = [all_spellings(b" " + w, pieces) for w in words]
    weights = np.array([1.0, 2, 1, 1, 3, 0])
    found = {}
    for together in (64, 1):
        monkeypatch.setattr(lattice, "TOGETHER_BYTES", together)
        twice = np.stack([vocabulary.scores, vocabulary.scores - 0.1], 1)
        both = np.stack([weights[:5], 2 * weights[:5]], 1)
        total, counts = lattice.Lattice(vocabulary, twice).words(words[:5], both)
        assert np.allclose(np.exp(total[:, 0]), expected[:5]) and (total[:, 1] < total[:, 0]).all()
        assert np.allclose(counts[:, 1], 2 * counts[:, 0])
        found[together] = counts[:, 0]
    assert np.allclose(found[64], found[1])
    # Expected pieces spell the bytes of all words.
    sizes = np.array([len(p) for p in pieces])
    assert math.isclose((found[64] * sizes).sum(), sum(w * (len(x) + 1) for w, x in zip(weights, words)))


def test_scores_of_documents(spark, stage, messy, nothing):
    import public_tokenizers

    path = public_tokenizers.path(lattice.VOCABULARY)
    rnd = random.Random(8)
    rows = [(i, prose(rnd, 40).replace("the", "THE")) for i in range(60)] + [(100, None), (101, ""), (102, "z" * 200)]
    rows += [(3, rows[3][1])]
    out = lattice.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), path, stage, entries=5).collect()
    assert len(out) == len(rows)
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(i, [w.translate(up) for w in re.findall(WORD, t or "")] + [None]) for i, t in rows]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, ws in tokens if not held[i] for w in ws)
    n = sum(c.values())
    expected = sorted(
        (i, held[i], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in ws), 6))
        for i, ws in tokens
    )
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == expected
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert lattice.score_documents(messy, path, stage).count() == len(messy_rows())
    assert lattice.score_documents(nothing, path, stage).count() == 0


# --- queries and pipeline ------------------------------------------------------------------

SF_DIR = "/root/testdata/sf0.001"


def test_queries_equal_their_sql(spark):
    from quotelens.llm.queries import ORACLES, QUERIES

    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    assert len(QUERIES) == 13 and len(ORACLES) >= 4
    for name, sql in ORACLES.items():
        df, expected = QUERIES[name](spark, SF_DIR), duck.sql(sql)
        assert sorted(df.columns) == sorted(expected.columns)
        theirs = expected.select(*[duckdb.ColumnExpression(c) for c in df.columns]).fetchall()
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, theirs)), name


def test_near_duplicate_query_equals_all_pairs(spark):
    from quotelens.llm.queries import QUERIES

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    found = QUERIES["op8_near_duplicates"](spark, SF_DIR).collect()
    assert sorted((r.doc_id, r.class_id) for r in found) == brute_classes(rows)


def test_pipeline(spark, tmp_path, messy, nothing):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.count() > 20 and out.filter("not round_trip").count() == 0
    for k, docs in enumerate((messy, nothing)):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            path = f"{tmp_path}/{k}/{name.replace(' ', '_')}"
            stage(spark, docs, SF_DIR).write.parquet(path)
            docs = spark.read.parquet(path)
            assert name == "byte-level BPE" or docs.columns == columns
    assert spark.createDataFrame(messy_rows(), SCHEMA).count() == len(messy_rows())


# --- memory of line comparison --------------------------------------------------------------


def test_pieces_hold_every_row_in_few_bytes(monkeypatch):
    monkeypatch.setattr(line_dedup, "PIECE_BYTES", 10)
    texts = ["abc", None, "", "äöü", "x" * 30, "tail", "more", "words", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["n", "text"])
    empty = batch.slice(0, 0)
    found = list(line_dedup._pieces(iter([batch, empty, batch.slice(2, 5)]), 1))
    assert [r for b in found for r in b.to_pylist()] == batch.to_pylist() + batch.to_pylist()[2:7]
    for b in found:
        size = sum(len((t or "").encode()) for t in b.column(1).to_pylist())
        assert b.num_rows == 1 or size <= 10


def test_pairs_of_a_large_batch_take_little_memory():
    class Given:
        """Stands for a frame: gives back the function that would run in a task."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3_000)]
    texts = ["\n".join(" ".join(rng.choice(words, 40)) for _ in range(12)) for _ in range(1_000)]
    texts += texts[:20]
    given = Given()
    given.sparkSession = Given()
    given.sparkSession.sparkContext = Given()
    given.sparkSession.sparkContext.broadcast = lambda value: type("Shared", (), {"value": value})
    frequent = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def run(patch):
        patch.setattr(line_dedup, "_word_weights", lambda _: frequent)
        patch.setattr(line_dedup, "text_of", lambda: type("Text", (), {"alias": lambda self, _: None})())
        (out,) = line_dedup._pair_rows(given)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))
        return out

    with pytest.MonkeyPatch.context() as patch:
        tracemalloc.start()
        out = run(patch)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert out.num_rows > 100_000 and peak < 40e6
        # Pieces change nothing: a line of several of them is told from others as in one.
        patch.setattr(line_dedup, "PIECE_BYTES", 1 << 40)
        assert run(patch).equals(out)


# --- work of line comparison ------------------------------------------------------------------


def test_only_variants_that_lines_share_are_joined(spark, stage, monkeypatch):
    start, other = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    ends = [" ".join(f"{x}{i}" for i in range(20)) for x in "cd"]
    # Two lines share their first half alone, two are one word apart, one is alone.
    rows = [(0, f"{start} {ends[0]}"), (1, f"{start} {ends[1]}"), (2, f"{other} x y"), (3, f"{other} x z"), (4, f"{ends[0]} end")]
    seen, table = {}, Staging.table

    def kept(self, df, name, by=None):
        written = table(self, df, name, by)
        seen[name] = written.collect()
        return written

    monkeypatch.setattr(Staging, "table", kept)
    gone = line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), stage)
    assert [(r.doc, r.line) for r in gone.collect()] == [(3, 0)]
    # Each of four lines, and itself without a word of its last half or of the word before.
    assert len(seen["around"]) == 4 + 2 * 21 + 2 * 12
    met = seen["met"]
    assert len({r.name for r in met}) == 2 and all(sum(x.key == r.key for x in met) > 1 for r in met)


def test_unlike_lines_with_a_rare_pair_are_not_compared(spark, stage, monkeypatch):
    rnd = random.Random(3)
    line = lambda: [f"w{rnd.randrange(10**6)}" for _ in range(60)]
    lines = [line() for _ in range(30)]
    for x in lines:
        x[20:24] = ["some", "rare", "words", "here"]
    near = list(lines[0])
    near[40:48] = line()[:8]
    rows = [(i, " ".join(x)) for i, x in enumerate([*lines, near])]
    # All words are as rare, so some lines have pairs of the four words among theirs.
    seen, table = [], Staging.table

    def kept(self, df, name, by=None):
        written = table(self, df, name, by)
        seen.append((name, written.count(), self))
        return written

    monkeypatch.setattr(Staging, "table", kept)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    gone = line_dedup.removed_lines(df, stage, grow=True)
    assert [r.doc for r in gone.collect()] == [30]
    assert sum(n for name, n, _ in seen if name == "close") == 1
    # Only what the result reads is still there.
    left = {name for name, _, at in seen if at is stage}
    assert left == {"lines", "kinds", "near"} and all(not at._paths for _, _, at in seen if at is not stage)


def staged_rows(monkeypatch):
    """Names of staged tables from now on, each with its numbers of rows."""
    seen, table = {}, Staging.table

    def kept(self, df, name, by=None):
        written = table(self, df, name, by)
        seen.setdefault(name, []).append(written.count())
        return written

    monkeypatch.setattr(Staging, "table", kept)
    return seen


@pytest.mark.parametrize("turns", [0, 1, 2])
def test_lines_told_again_equal_all_pairs(spark, stage, monkeypatch, turns):
    monkeypatch.setattr(line_dedup, "HOT_LINES", 2)
    monkeypatch.setattr(line_dedup, "TURNS", turns)
    rnd = random.Random(21)
    passage = [rnd.choice(WORDS) for _ in range(30)]
    base = [[rnd.choice(WORDS) for _ in range(n)] for n in (9, 12, 15, 20, 31)]
    rows = []
    for i in range(60):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(3 + len(w) // 4)):
            k, p = rnd.choice("dis"), rnd.randrange(len(w) + 1)
            w[p : p + (k != "i")] = [] if k == "d" else [rnd.choice(WORDS)]
        rows.append((i, " ".join(w + passage * (i % 3 == 0))))
    words = [x.split() for _, x in rows]
    near = lambda a, b: edit_distance(a, b) <= max(1, max(len(a), len(b)) // 5)
    expected = {i for i, w in enumerate(words) if len(w) >= 5 and any(len(v) >= 5 and near(w, v) for v in words[:i])}
    seen = staged_rows(monkeypatch)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc for r in line_dedup.removed_lines(df, stage, grow=True).collect()} == expected
    assert len(seen["sizes"]) == turns + 1 and seen["sizes"][0] > 0


def test_lines_with_a_common_passage_are_not_all_compared(spark, stage, monkeypatch):
    """As many links as lines, not as pairs of them, where lines of their own share a passage."""
    rnd = random.Random(8)
    own = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage, n = own(60), 200
    rows = [(i, " ".join(own(26) + passage)) for i in range(n)]
    # One edit more than the first line's bound, and within that of another.
    near = rows[120][1].split()
    near[3:13] = own(10)
    rows.append((n, " ".join(near)))
    seen = staged_rows(monkeypatch)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert [r.doc for r in line_dedup.removed_lines(df, stage, grow=True).collect()] == [n]
    assert sum(seen["links"]) <= 2 * n


def test_sketches_tell_at_most_two_bits_an_edit():
    rnd = random.Random(4)
    for _ in range(50):
        a = [f"w{rnd.randrange(40)}" for _ in range(rnd.randint(5, 60))]
        b = list(a)
        for _ in range(3):
            k, p = rnd.choice("dis"), rnd.randrange(len(b))
            b[p : p + (k != "i")] = [] if k == "d" else [f"w{rnd.randrange(40)}"]
        words, _, _ = line_dedup._lines(pa.array([" ".join(a), " ".join(b)]))
        for size in (1, 4):
            x, y = line_dedup.Lines(words).sketches(np.arange(2), size)
            assert sum(int(v).bit_count() for v in x ^ y) <= 6
            assert sum(int(v).bit_count() for v in x) <= len(a)


def test_rare_pairs_meet_at_the_bound():
    rnd = random.Random(6)
    hashed = lambda w: np.array([hash(x) & (2**62 - 1) for x in w], np.uint64)
    for _ in range(3_000):
        a = [rnd.randrange(60) for _ in range(rnd.randint(8, 31))]
        b = list(a)
        # As many edits as the longer of both allows, put in ones more often.
        while line_dedup.edits_between(a, b) <= max(len(a), len(b)) // 5:
            last, b = b, list(b)
            k, p = rnd.choice("disii"), rnd.randrange(len(b))
            b[p : p + (k != "i")] = [] if k == "d" else [rnd.randrange(60, 999)]
        weight = [np.array([x % 7 for x in w], np.int64) for w in (a, last)]
        (x, _, _), (y, _, _) = (
            line_dedup._rare_pairs(hashed(w), v, np.array([0, len(w)]))[0] for w, v in zip((a, last), weight)
        )
        if max(len(a), len(last)) >= 10:
            assert set(x.tolist()) & set(y.tolist())

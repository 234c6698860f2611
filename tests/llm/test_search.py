"""Ranked search against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from corpus_fixture import messy_rows

from quotelens.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]+", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, top):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    total, held = sum(n for *_, n in counted), len(counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in counted:
            m = 100 - 50 + (50 * n * held) // total
            score = sum(
                math.floor(1000 * math.log((2 * held + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(terms(text))
                if t in c
            )
            if score > 0:
                found.append((-score, i is None, i or 0))
        found.sort()
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(found[:top], 1)]
    return sorted(out, key=repr)


def found(out):
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_terms():
    text = "It's NAÏVE 日本語-x_9\tÀ@z\n\x7f"
    words = search.terms_of(pa.array([text, None, "", "--"]))
    assert [words.bytes_at(i).decode() for i in range(len(words))] == terms(text)
    assert words.counts().tolist() == [len(terms(text)), 0, 0, 0]


def corpus(seed, n):
    """Topics with words of their own, common words, groups of copies, ties."""
    rnd = random.Random(seed)
    common = [f"c{i}" for i in range(8)]
    docs = []
    for i in range(n):
        topic = rnd.randrange(6)
        words = [rnd.choice(common) if rnd.random() < 0.5 else f"t{topic}_{rnd.randrange(12)}" for _ in range(rnd.choice((1, 5, 20, 60)))]
        docs.append((rnd.randrange(n), docs[rnd.randrange(len(docs))][1] if docs and rnd.random() < 0.3 else " ".join(words)))
    items = [(j, " ".join(f"t{j % 6}_{rnd.randrange(12)}" for _ in range(4)) + " c1 C2 c3") for j in range(9)]
    return docs, [*items, (0, "c0 c1"), (None, "t1_1"), (77, None), (78, "nowhere")]


@pytest.mark.parametrize(("seed", "n", "shard", "block", "top"), [(1, 700, 50, 4, 10), (2, 700, 4096, 16, 50), (3, 60, 7, 2, 100)])
def test_equals_scoring_every_document(spark, stage, seed, n, shard, block, top):
    docs, items = corpus(seed, n)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    out = search.search(d, q, stage, top, shard_docs=shard, block_docs=block)
    assert found(out) == brute(docs, items, top)


def test_bounds_hold_and_blocks_are_skipped(spark, stage):
    docs, items = corpus(4, 900)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    counts = search.search(d, q, stage, 5, explain=True, shard_docs=128, block_docs=4).collect()
    assert sum(r.n_opened for r in counts) < 0.5 * sum(r.n_blocks for r in counts)


def test_summaries_bound_every_document_of_a_block():
    docs, items = corpus(5, 300)
    queries = search.Queries.of([i for i, _ in items], pa.array([t for _, t in items]))
    forward = search._forward(queries.keys)
    rows = pa.concat_tables([pa.Table.from_batches(forward([pa.record_batch({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs]})]))])
    df = np.bincount(rows.column("terms").combine_chunks().flatten().to_numpy(), minlength=len(queries.keys))
    by = np.argsort(df, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    weights, queries = search.term_weights(300, df[by]), queries.renumbered(place)
    total = sum(len(terms(t)) for _, t in docs)
    batch = rows.append_column("row", pa.array(range(len(docs)))).combine_chunks().to_batches()[0]
    table = pa.Table.from_batches(search._weighed(place, weights, 300, total)([batch]))
    shard = search.Shard.of(table, weights, queries.masks(), 8)
    for i in range(len(queries.ids)):
        asked = queries.terms[queries.at[i] : queries.at[i + 1]]
        blocks, bound = shard.bounds(asked, weights)
        for b, most in zip(blocks, bound):
            for d, score in zip(*shard.scores(np.array([b]), asked, weights)):
                mine = shard.terms[shard.at[d] : shard.at[d + 1]]
                if not len(asked) or min(set(mine) & set(asked)) == shard.block_terms[b]:
                    assert score <= most


def test_terms_of_an_item_share_a_bit(monkeypatch):
    for bits in (1024, 64):
        monkeypatch.setattr(search, "MASK_BITS", bits)
        queries = search.Queries.of(list(range(300)), pa.array([f"a{i} b{i % 7} c" for i in range(300)]))
        masks = queries.masks()
        assert masks.shape[1] == min(5, bits // 64)
        for i in range(300):
            first, *rest = queries.terms[queries.at[i] : queries.at[i + 1]]
            assert all((masks[first] & masks[t]).any() for t in rest)


def test_items_in_parts(spark, stage, monkeypatch):
    monkeypatch.setattr(search, "QUERY_CHARS", 60)
    docs, items = corpus(6, 80)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(search.search(d, q, stage, 4)) == brute(docs, items, 4)


def test_messy_rows_and_sql(spark, messy, nothing, stage):
    given = [(i, t) for i, t, *_ in messy_rows()]
    items = [(1, "the same words"), (2, None), (2, "of the row few KURZ"), (None, "日本語 enough"), (5, "")]
    q = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    ours = found(search.search(messy, q, stage))
    assert ours == brute(given, items, 50) and ours
    con = duckdb.connect()
    con.register("documents", messy.select("doc_id", "text").toArrow())
    con.register("benchmark", q.select("item_id", "text").toArrow())
    assert sorted(con.sql(search.search_sql()).fetchall(), key=repr) == ours
    assert found(search.search(nothing, q, stage)) == []
    assert found(search.search(messy, q.limit(0), stage)) == []

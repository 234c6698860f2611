"""The hash tree against one built in Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest
from corpus_fixture import SCHEMA, messy_rows

from quotelens.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    coded = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha(*["-" if v is None else f"{len(v.encode())}:{v}" for v in coded])


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([sha(*found[-1][i : i + 2]) for i in range(0, len(found[-1]), 2)])
    return found


def path(tree, i):
    """(left, right) of every level below the root."""
    found = []
    for nodes in tree[:-1]:
        found.append((nodes[i - 1], "") if i % 2 else ("", nodes[i + 1] if i + 1 < len(nodes) else ""))
        i //= 2
    return found


def expected(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for doc_id, text, lang, source, n in rows:
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n is not None
        plain = leaf(doc_id, source, lang, n, text)
        groups.setdefault(lang, []).append((doc_id, plain, leaf(doc_id, source, lang, n + 1, text) if hit else plain))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(levels([x[1] for x in groups[g]]))
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(order):
        for i, (doc_id, plain, start) in enumerate(groups[g]):
            steps = path(trees[k], i) + path(top, k)
            folded = start
            for left, right in steps:
                folded = sha(left, folded, right)
            root = top[-1][0]
            proof = sha(*[x for step in steps for x in step])
            out.append((doc_id, plain, trees[k][-1][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


def found(out):
    assert out.columns == "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize(("depth", "n"), [(2, 230), (3, 64), (2, 1), (10, 40)])
def test_equals_a_tree_built_in_python(spark, stage, monkeypatch, depth, n):
    """Full blocks, blocks of one, several tiers, groups of one row."""
    monkeypatch.setattr(merkle, "DEPTH", depth)
    rnd = random.Random(n)
    rows = [
        (i, "x" * rnd.randrange(5) + "é", rnd.choice([None, "en", "en", "en", "de"] if i else ["zz"]), "s", i)
        for i in range(n)
    ]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ours = found(merkle.audit(df, stage))
    assert ours == expected(rows)
    if n > 7:
        assert 0 < sum(not r[-1] for r in ours) < n / 3


def test_many_groups_take_tiers_too(spark, stage, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 2)
    rows = [(i, "t", f"l{i % 23}", None, None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert found(merkle.audit(df, stage)) == expected(rows)


def test_messy_rows_and_sql(messy, nothing, stage):
    given = [(i, t, g, s, n) for i, t, g, s, n, *_ in messy_rows()]
    ours = found(merkle.audit(messy, stage))
    assert ours == expected(given) and len(ours) == len(given)
    assert found(merkle.audit(nothing, stage)) == []
    documents = messy.select(*SCHEMA.split(" ")[0:1], "text", "lang", "source", "n_chars").toArrow()
    con = duckdb.connect()
    con.register("documents", documents)
    assert sorted(con.sql(merkle.audit_sql()).fetchall(), key=repr) == ours


def test_clashing_names_and_other_columns(spark, stage):
    """Any columns may stand beside those read, and a proof carries what is asked for."""
    df = spark.createDataFrame(
        [(1, "a", "en", "s", 1, "g", "b", "n", "h"), (2, "b", "en", "s", 1, "g", "b", "n", "k")],
        "doc_id long, text string, lang string, source string, n_chars long, `group` string, block string, node string, h string",
    )
    out = merkle.prove(df, stage, columns=["text", "h"], group="group", carry=["h", "node"])
    assert [(r["group"], r.doc_id, r.h, r.node, r.leaf) for r in out.orderBy("doc_id").collect()] == [
        ("g", 1, "h", "n", sha("1:a", "1:h")),
        ("g", 2, "k", "n", sha("1:b", "1:k")),
    ]

"""Words, byte-level BPE and token counts against regular expressions and the libraries."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from corpus_fixture import messy_rows

from quotelens.llm import bpe, token_counts
from quotelens.llm.common import WORD, HashTable, most_frequent, shingles_of, words_of

TEXTS = [r[1] for r in messy_rows()]
ENCODER = bpe.load(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ENCODER.ranks, special_tokens={}
    )


def test_words_are_those_of_the_pattern():
    words = words_of(pa.array(TEXTS, pa.string()).slice(1))
    for i, text in enumerate(TEXTS[1:]):
        found = [words.bytes_at(k).decode() for k in range(words.offsets[i], words.offsets[i + 1])]
        assert found == re.findall(WORD, text or "")


def test_equal_words_have_equal_hashes_and_others_do_not():
    words = words_of(pa.array(["a b a", "ab a b", "a" * 3000000 + " b"]))
    h = words.hashes()
    assert h[0] == h[2] == h[4] and h[1] == h[5] == h[7]
    assert len({int(x) for x in h}) == 4


def test_shingles_do_not_cross_texts_and_short_texts_are_one():
    found = shingles_of(words_of(pa.array(["a b c d e f", "", "a b", "b c d e f", None, " a  b\n"])))
    assert found.texts.tolist() == [0, 0, 2, 3, 5]
    assert found.values[1] == found.values[3] and found.values[2] == found.values[4]


def test_hash_table_finds_every_key_and_no_other():
    rnd = np.random.default_rng(1)
    keys = np.unique(rnd.integers(0, 2**63, 5000).astype(np.uint64))
    table = HashTable(keys, np.arange(len(keys)), -1)
    assert (table.get(keys) == np.arange(len(keys))).all()
    assert (table.get(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


@pytest.mark.parametrize("alphabet", ["ab", "a", "the of and \n", "éàü日本語 🎉x", " \n\t", "'s It's 12"])
def test_bpe_equals_the_library(reference, alphabet):
    rnd = random.Random(alphabet)
    for n in (0, 1, 2, 17, bpe.MATRIX_BYTES, bpe.MATRIX_BYTES + 1, 3000):
        text = "".join(rnd.choice(alphabet) for _ in range(n))
        assert ENCODER.encode(text).tolist() == reference.encode_ordinary(text)


def test_long_texts_go_in_pieces_and_a_full_cache_is_renewed(reference, monkeypatch):
    monkeypatch.setattr(bpe, "GROUP_CHARS", 50)
    monkeypatch.setattr(bpe, "PIECE_MATCHES", 7)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    encoder = bpe.Encoder(ENCODER.ranks, public_tokenizers.PATTERN)
    texts = ["one two three four five six", "seven " * 60, "", "eight nine ten one two"]
    assert [x.tolist() for x in encoder.encode_all(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_encoding_documents_round_trips_and_keeps_other_columns(messy, nothing, reference):
    path = public_tokenizers.path(bpe.VOCABULARY)
    out = bpe.encode_documents(messy, path, public_tokenizers.PATTERN, ids="Band", decoded="back")
    rows = out.collect()
    assert len(rows) == len(TEXTS) and rows[0]["__text"] == "clash"
    for r in rows:
        assert bytes(r.back).decode() == (r.text or "")
        assert r.Band == reference.encode_ordinary(r.text or "")
    assert bpe.encode_documents(nothing, path, public_tokenizers.PATTERN).count() == 0


def test_digests(messy, reference):
    path = public_tokenizers.path(bpe.VOCABULARY)
    rows = bpe.token_digests(messy, path, public_tokenizers.PATTERN).collect()
    expected = []
    for i, text, *_ in messy_rows():
        ids = reference.encode_ordinary(text or "")
        expected.append(
            (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
             hashlib.sha256((text or "").encode()).hexdigest())
        )
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, expected))


@pytest.mark.parametrize("entries", [0, 3, token_counts.TABLE_ENTRIES])
def test_token_counts_equal_the_library_whatever_the_table_holds(messy, nothing, stage, entries):
    path = public_tokenizers.path(token_counts.VOCABULARY)
    library = token_counts.tokenizer(path)
    out = token_counts.count_tokens(messy, path, stage, out="Band", entries=max(entries, 1))
    for r in out.collect():
        assert r.Band == len(library.encode(r.text or "", add_special_tokens=False).ids)
    assert token_counts.count_tokens(nothing, path, stage).count() == 0


def test_frequent_pretokens_come_from_all_texts(spark, stage):
    df = spark.createDataFrame([("often often often rare",)] * 50 + [("seldom seldom",)], "text string")
    assert token_counts.frequent_pretokens(df.repartition(3), stage, entries=1) == [b"often"]
    with pytest.raises(ValueError, match="tokenizers"):
        token_counts.count_tokens(df, "some.model", stage)


def test_the_most_frequent_fit_and_lose_to_none_outside(spark):
    rnd = random.Random(8)
    numbers = [0, 0, 1, 1, 1, 1] + [int(2 ** rnd.uniform(0, 40)) for _ in range(300)]
    df = spark.createDataFrame([(n,) for n in numbers], "n long").repartition(7)
    for entries in (0, 1, 3, 50, 300, 304, 305, 1000):
        kept = sorted((r.n for r in most_frequent(df, "n", entries).collect()), reverse=True)
        assert len(kept) <= entries and kept == sorted(numbers, reverse=True)[: len(kept)]
        # Only one step of a sixteenth of a doubling may be missing.
        left = sorted((n for n in numbers if n > 0), reverse=True)[len(kept) :]
        assert not left or len(kept) + sum(n >= left[0] / 2 ** (1 / 16) for n in left) > entries

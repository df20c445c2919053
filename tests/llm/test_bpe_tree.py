"""Ids of the tree reduction against the library, whole texts at once."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pageledger.llm import bpe_tree
from pageledger.llm.registered import op11_byte_bpe

SMALL = bpe_tree.Encoder(leaf=8, window=12)
LARGE = bpe_tree.encoder()


def check(text):
    expected = LARGE.plain(text)
    assert SMALL.encode(text) == expected
    assert SMALL.decode(expected) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab  \n\t'sredtlvm.,-1٣ä中　\x1c\x85é́😀"), max_size=80))
def test_mixed_texts(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("the ing"), min_size=30, max_size=200))
def test_words(text):
    check(text)
    check(text.replace(" ", ""))


@pytest.mark.parametrize("text", ["a" * 5001, "ab" * 3000, " " * 4001, "\n" * 3001 + "x", "'" * 999 + "s" * 999, "=" * 6000, "中" * 2000, "he's " * 700, "1" * 5000, "ha" * 999 + "'ll" + " x" * 99, "😀" * 800])
def test_long_matches(text):
    check(text)
    assert LARGE.encode(text) == LARGE.plain(text)


def test_long_match_takes_little_more_than_linear_time():
    rng = random.Random(2)
    data = "".join(rng.choices("etaoinshrdlu", k=400_000))
    ids = LARGE.encode(data)
    assert LARGE.decode(ids) == data.encode()
    assert all(LARGE.holds(a, b) for a, b in zip(ids, ids[1:]))


def test_joining_changes_the_border_only():
    text = "some words and words " * 40
    left, right = LARGE.plain(text[:400]), LARGE.plain(text[400:])
    before, after = LARGE.around(text, 0, 400, len(text))
    assert after - before < 12
    assert LARGE.join(text, before, 400, after, left, right) == LARGE.plain(text)


def texts():
    rng = random.Random(4)
    found = ["", None, " ", "x" * 700, "<|endoftext|> ok", "a\r\n\r\n  b", "word " * 300, "they're " * 90 + "e" * 400 + " fin"]
    return found + ["".join(rng.choices(["the", " ", "  ", "\n", "Größe", "'re", "12", ".", "中文"], k=rng.randint(1, 300))) for _ in range(40)]


def test_segments_of_long_texts(spark):
    rows = list(enumerate(texts())) + [(None, "null id " * 40), (3, "x" * 700)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id bigint, text string, ids int")
    found = bpe_tree.encode(docs, segment=64).collect()
    assert sorted(map(str, found)) == sorted(str(type(found[0])("doc_id", "ids")(i, LARGE.plain(t or ""))) for i, t in rows)


def test_query(spark, tmp_path):
    rows = list(enumerate(texts()))
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    found = {row[0]: tuple(row) for row in op11_byte_bpe(spark, str(tmp_path)).select(*names).collect()}
    for i, t in rows:
        ids = LARGE.plain(t or "")
        digests = [hashlib.sha256(data).hexdigest() for data in (" ".join(map(str, ids)).encode(), (t or "").encode())]
        assert found[i] == (i, len(ids), *digests)
    assert len(found) == len(rows)


def test_decoding_keeps_other_columns(spark):
    encoded = spark.createDataFrame([(1, [15496], "a"), (2, None, "b")], "`doc.id` int, ids array<int>, decoded string")
    assert sorted((row[0], bytes(row[1])) for row in bpe_tree.decode(encoded).collect()) == [(1, b"Hello"), (2, b"")]


def test_no_rows(spark):
    assert bpe_tree.encode(spark.createDataFrame([], "doc_id int, text string")).count() == 0

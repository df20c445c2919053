import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageledger.llm import exact_dedup
from pageledger.llm.exact_dedup import Polynomial


def lowered(text):
    return (text or "").encode().lower()


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lowered(text)].append(doc_id)
    result = []
    for doc_id, text in rows:
        ids = groups[lowered(text)]
        keep = max((x for x in ids if x is not None), default=None)
        result.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256(lowered(text)).hexdigest(), len(lowered(text))))
    return result


ROWS = [
    (1, "Same text"), (2, "same TEXT"), (3, "same text"), (4, "É"), (5, "é"), (6, None), (7, ""), (7, ""), (8, "x" * 700), (9, "X" * 700),
    (10, "x" * 699 + "y"), (None, "same text"), (None, "alone"), (11, "alone\0"), (12, "\0"), (13, "\0\0"),
]
OPTIONS = [{}, {"chunk": 16}, {"chunk": 16, "huge": 64}, {"chunk": 8, "huge": 16, "moduli": (3, 2)}]


def order(row):
    return (row[0] is None, row[0] or 0, row[4])


@pytest.mark.parametrize("options", OPTIONS)
def test_against_brute_force(spark, options):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumn("keep_id", F.lit("clash"))
    found = [tuple(r)[:6] for r in exact_dedup.exact_duplicates(docs, **options).collect()]
    assert sorted(found, key=order) == sorted(brute(ROWS), key=order)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert exact_dedup.exact_duplicates(docs).count() == 0
    assert exact_dedup.drop_duplicates(docs).count() == 0


def test_dropping_keeps_columns_and_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in ROWS], "doc_id bigint, text string, source string")
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 3, 4, 5, 7, 9, 10, 11, 12, 13]


@settings(deadline=None, max_examples=60)
@given(st.binary(max_size=200), st.binary(max_size=200), st.integers(1, 50))
def test_fingerprints_combine(left, right, chunk):
    hasher = Polynomial(chunk)
    assert hasher.of(left + right) == hasher.combine(hasher.of(left), hasher.of(right), len(right))
    assert hasher.of(left) == Polynomial(97).of(left)


def test_a_hot_group_is_whole(spark):
    rng = random.Random(1)
    rows = [(i, "copy" if i % 3 else str(rng.random())) for i in range(900)]
    found = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert {(r["keep_id"], r["group_size"]) for r in found if r["group_size"] > 1} == {(899, 600)}

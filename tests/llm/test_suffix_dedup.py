import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageledger.llm import suffix_dedup
from pageledger.llm.suffix_dedup import MATCH


def brute(rows):
    first = {}
    order = {at: (2**63 if doc_id is None else doc_id) for at, (doc_id, _) in enumerate(rows)}
    texts = [(text or "").encode() for _, text in rows]
    for at, text in enumerate(texts):
        for i in range(len(text) - MATCH + 1):
            piece = text[i : i + MATCH]
            first[piece] = min(first.get(piece, order[at]), order[at])
    result = []
    for at, text in enumerate(texts):
        gone = bytearray(len(text))
        for i in range(len(text) - MATCH + 1):
            if first[text[i : i + MATCH]] < order[at]:
                gone[i : i + MATCH] = b"\1" * MATCH
        spans, i = [], 0
        while i < len(text):
            j = i
            while j < len(text) and gone[j]:
                j += 1
            if j > i:
                spans.append((i, j))
            i = j + 1
        kept = bytes(b for b, g in zip(text, gone) if not g)
        result.append((rows[at][0], len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return result


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("batch", F.lit(1)).repartition(3)
    found = [(r["doc_id"], r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], r["kept_sha256"]) for r in suffix_dedup.repeated_passages(docs, **options).collect()]

    def key(row):
        return (row[0] is None, row[0] or 0, row[4])

    assert sorted(found, key=key) == sorted(brute(rows), key=key)


def passages(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    words = lambda n: " ".join(word() for _ in range(n))
    shared = [words(rng.randint(10, 60)) for _ in range(6)]
    rows = []
    for at in range(60):
        parts = [words(rng.randint(0, 40)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            piece = rng.choice(shared)
            a = rng.randint(0, len(piece) // 2)
            parts.insert(rng.randint(0, 2), piece[a:])
        rows.append((1000 - at * 7, "".join(parts)))
    copy = rows[7][1]
    rows += [(5, copy), (5, copy), (5, copy + "x"), (-3, copy[20:]), (None, copy), (None, words(50)), (6, None), (8, ""), (9, "short"), (2**62, copy)]
    rows += [(20, "a" * 300), (21, "a" * 49), (22, "b" + "a" * 120 + "b"), (23, "a" * 50), (24, "é" * 60), (25, "xé" + "é" * 40)]
    return rows


def test_against_brute_force(spark):
    check(spark, passages())


def test_hot_buckets_are_dealt_by_string(spark):
    check(spark, passages(9), hot=3)


def test_one_long_text_and_empty_table(spark):
    rng = random.Random(1)
    long = "".join(rng.choices("ab c", k=80_000))
    check(spark, [(1, long), (2, long[500:900] + "zz" + long[70_000:]), (3, "q" + long[850:1000])])
    assert suffix_dedup.repeated_passages(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_refined_identifiers(letters):
    text = np.frombuffer("".join(random.Random(2).choices(letters, k=400)).encode() * 3, np.uint8)
    found = suffix_dedup.refine(text)
    strings = [text[at : at + MATCH].tobytes() for at in range(len(text) - MATCH + 1)]
    assert len(found) == len(strings)
    named = {}
    for identifier, string in zip(found.tolist(), strings):
        assert named.setdefault(string, identifier) == identifier
    assert len(set(named.values())) == len(named)

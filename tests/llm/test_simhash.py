import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from pageledger.llm import simhash
from pageledger.llm.common import Scratch


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    bits = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        bits.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def roots(items, linked):
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = list(items)
    for i, a in enumerate(items):
        for b in items[:i]:
            if linked(a, b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in items}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("key_bits", [6, 9])
def test_links_connect_as_all_pairs_do(spark, radius, key_bits):
    rng = random.Random(radius)
    values = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(6):
            values.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    frame = spark.createDataFrame([(signed(x),) for x in values], "fp bigint")
    found = simhash.components(simhash.links(frame, radius, key_bits), Scratch(spark, "t")).collect()
    names = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in found}
    names = {x: names.get(x, x) for x in values}
    expected = roots(values, lambda a, b: (a ^ b).bit_count() <= radius)
    groups = lambda named: sorted(sorted(x for x in named if named[x] == n) for n in set(named.values()))
    assert groups(names) == groups(expected)


def test_documents(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n\t", "one", "ONE", "a b c", "a b c d"]
    for _ in range(20):
        base = rng.choices(words, k=rng.randint(60, 400))
        texts.append(" ".join(base))
        for _ in range(3):
            base = list(base)
            base[rng.randrange(len(base))] = "edited"
            texts.append("\x0b".join(base).title())
    rows = [(500 - 3 * at, text) for at, text in enumerate(texts)] + [(None, texts[9]), (2, texts[9]), (2, texts[9])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("clash")).repartition(3)
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    fps = {text: brute_fingerprint(text) for _, text in rows}
    named = roots(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for doc_id, text in rows:
        if doc_id is not None:
            root = named[fps[text]]
            least[root] = min(least.get(root, doc_id), doc_id)
    expected = Counter((doc_id, fps[text], least[named[fps[text]]]) for doc_id, text in rows)
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found) == expected
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(set(r["doc_id"] for r in kept.collect())) == sorted(set(least.values()))


def test_empty_table_and_many_equal_texts(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(docs).count() == 0
    many = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("the same few words again").alias("text"))
    assert {r["component_id"] for r in simhash.near_duplicates(many).collect()} == {0}

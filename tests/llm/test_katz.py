import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageledger.llm import katz

WORDS = "a bb ccc Dd e1 fé g, hh ii jj".split()


def sample(n, seed=1):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, weights=range(10, 0, -1), k=rng.randint(0, 30))) for _ in range(n)]
    texts[0], texts[1], texts[2] = None, "", "  \t\n unseen\x0bword zz "
    texts[3] = texts[4]
    return [(at if at != 5 else None, text, at % 4 != 1) for at, text in enumerate(texts)]


def brute(rows):
    k = katz.K

    def tokens(text):
        return [w.lower() for w in (text or "").encode().split()] + [b"</s>"]

    one, two, contexts = Counter(), Counter(), Counter()
    for _, text, train in rows:
        if train:
            ts = tokens(text)
            one.update(ts)
            two.update(zip([b"<s>", *ts], ts))
    for (a, _), n in two.items():
        contexts[a] += n
    n_tokens = sum(one.values())

    def by_count(counts):
        return [float(sum(1 for n in counts.values() if n == r)) for r in range(1, k + 2)]

    d1, d2 = katz.discounts(by_count(one)), katz.discounts(by_count(two))
    left = sum((1 - d1[n]) * n for n in one.values() if n <= k)

    def p1(w):
        n = one[w]
        return (d1[n] if n <= k else 1) * n / n_tokens if n else left / n_tokens

    seen = defaultdict(list)
    for (a, b), n in two.items():
        seen[a].append((b, n))

    def p2(a, b):
        if not contexts[a]:
            return p1(b)
        mass = sum((1 - d2[n]) * n for _, n in seen[a] if n <= k)
        whole = contexts[a]
        none = mass <= 0
        if none:
            mass, whole = 1.0, whole + 1
        n = two[a, b]
        if n:
            return (1 if none or n > k else d2[n]) * n / whole
        return mass / whole / (1 - sum(p1(w) for w, _ in seen[a])) * p1(b)

    result = []
    for doc_id, text, train in rows:
        ts = tokens(text)
        base = sum(math.log10((one[t] + 0.5) / (n_tokens + 0.5 * (len(one) + 1))) for t in ts)
        score = sum(math.log10(p2(a, b)) for a, b in zip([b"<s>", *ts], ts))
        result.append((doc_id, train, len(ts), sum(one[t] > 0 for t in ts), n_tokens, base, score))
    vocabulary = [*one, b"never"]
    for a in [*list(contexts)[:6], b"never"]:
        assert sum(p2(a, b) for b in vocabulary) == pytest.approx(1.0, abs=1e-9)
    return result


def close(found, expected):
    def key(row):
        return (row[0] is None, row[0] or 0)

    found, expected = sorted(map(tuple, found), key=key), sorted(expected, key=key)
    assert len(found) == len(expected)
    for a, b in zip(found, expected):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], abs=1e-9)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, train boolean").withColumn("batch", F.lit("x"))


@pytest.mark.parametrize("n", [40, 400])
def test_against_brute_force(spark, n):
    rows = sample(n)
    close(katz.score(frame(spark, rows).repartition(3)).collect(), brute(rows))


def test_frequent_contexts_are_split(spark, monkeypatch):
    rows = sample(3000, 4)
    monkeypatch.setattr(katz, "BATCH_BYTES", 20_000)
    monkeypatch.setattr(katz, "HASH_BYTES", 3_000)
    close(katz.score(frame(spark, rows)).collect(), brute(rows))


def test_no_training_rows_and_no_rows(spark):
    rows = [(1, "a b", False), (2, None, None)]
    found = {r["doc_id"]: r for r in katz.score(frame(spark, rows)).collect()}
    assert (found[1]["n_tokens"], found[1]["n_known"], found[1]["train_tokens"]) == (3, 0, 0)
    assert found[2]["score"] == 0.0
    assert katz.score(frame(spark, [])).count() == 0


def test_hashes_follow_words():
    texts = [b"", b"Ab c", b" \n", b"c  aB\x0b", "é É".encode()]
    offsets = np.cumsum([0, *map(len, texts)])
    hashes, n = katz.token_hashes(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert n.tolist() == [0, 2, 0, 2, 2]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[2] and len(set(hashes.tolist())) == 4

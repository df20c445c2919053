"""Runs against a search by definition, and the planted form against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from pageledger.llm.periodic_runs import _searched, find_runs, periodic_runs
from pageledger.llm.registered import op13_periodic_runs


def brute(words):
    """All maximal stretches of at least max(24, 3 q) words, smallest period first."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - at >= max(24, 3 * q):
                found.setdefault((at, end + q), q)
            at = end
    return sorted((a, b - a, q) for (a, b), q in found.items())


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def cases():
    rng = random.Random(5)
    yield []
    yield [1] * 24
    yield [1] * 23
    yield thue_morse(700)
    yield fibonacci(600)
    for _ in range(60):
        size = rng.choice([1, 2, 3, 50])
        words = [rng.randrange(size) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(1, 5)):
            q = rng.choice([1, 2, 3, 5, 7, 8, 9, 13, 16, 21, 31, 33, 60])
            block = [rng.randrange(size) for _ in range(q)]
            if rng.random() < 0.4:  # mostly one word, so that the period hides a highly periodic region
                block = [0] * (q - q // 8 - 1) + [rng.randrange(9) for _ in range(q // 8 + 1)]
            times = rng.choice([2.5, 3, 3.2, 4, 7])
            words += (block * 8)[: int(q * times) + rng.randrange(3)]
            words += [rng.randrange(size) for _ in range(rng.randrange(6))]
        if rng.random() < 0.3:  # runs of runs
            words = words[:70] * 4
        yield words


def test_runs_of_many_texts_at_once():
    texts = list(cases())
    numbers = np.array([x for at, words in enumerate(texts) for x in [*words, -1 - at]], np.int64)
    a, b, q = find_runs(numbers, np.array([len(words) for words in texts]))
    opens = np.cumsum([0] + [len(words) + 1 for words in texts])
    for at, words in enumerate(texts):
        mine = [(int(x - opens[at]), int(y - x), int(z)) for x, y, z in zip(a, b, q) if opens[at] <= x < opens[at + 1]]
        assert mine == brute(words), at


def test_long_periods():
    rng = random.Random(1)
    block = [rng.randrange(1 << 30) for _ in range(3001)]
    words = [1, 2] + block * 3 + block[:17] + [3] + [7] * 5000
    a, b, q = find_runs(np.array([*words, -1], np.int64), np.array([len(words)]))
    assert list(zip(a.tolist(), (b - a).tolist(), q.tolist())) == [(2, 9020, 3001), (9023, 5000, 1)]


def test_words_split_at_ascii_spaces_only():
    text = ("a b\x1c\tc\x0b" * 30).encode()
    runs, collapsed = _searched([text, b""])
    assert runs == [[{"start": 0, "length": 60, "period": 2}], []]
    assert collapsed == ["a b\x1c c", ""]


def planted(doc_id, text):
    words = text.encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text or "")
    runs = brute(words)
    out = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in out)
    milli = None if not runs else 1000 * best[1] // best[2]
    return (len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["der", "die", "ä", "und", "x y"], k=rng.choice([0, 1, 30, 90, 200])))) for i in range(150)]
    rows += [(151, None), (152, ""), (153, " \n\t"), (0, "la " * 40), (0, "la " * 40)]
    spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id bigint, text string, runs int, `a.b` string").write.parquet(f"{tmp_path}/documents.parquet")
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = op13_periodic_runs(spark, str(tmp_path)).select("doc_id", *names).collect()
    assert sorted(map(str, found)) == sorted(map(str, [type(found[0])("doc_id", *names)(i, *expected(i, t)) for i, t in rows]))


@pytest.mark.parametrize("rows", [[], [(None, None), (None, "a " * 30)]])
def test_small_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert periodic_runs(docs).count() == len(rows)

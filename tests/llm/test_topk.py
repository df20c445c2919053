import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageledger.llm import topk


def brute(rows, k=5):
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    found = set()
    for q, v in vectors:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q and len(w) == len(v))[:k]
            found |= {(q, at + 1, i, -s) for at, (s, i) in enumerate(scores)}
    return found


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("v", F.lit(1)).repartition(3)
    vectors = topk.quantised(frame)
    return {tuple(r) for r in topk.exact_top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5, **options).collect()}


@pytest.mark.parametrize("options", [{}, {"block_rows": 64}])
def test_against_brute_force(spark, options):
    rng = random.Random(5)
    rows = [(i, [rng.randint(-8, 8) / 16 for _ in range(6)]) for i in range(700)]
    rows[50] = (50, [0.0] * 6)
    rows[100] = (100, [0.5] * 6)
    rows[101] = rows[102] = (101, [0.5] * 6)
    rows += [(800, None), (850, []), (801, [1.0, None]), (802, [float("nan")] * 6), (803, [float("inf")] * 6), (900, [1.0, 2.0]), (901, [3.0, 1.0]), (950, [1.0] * 3), (None, [1.0] * 6)]
    assert run(spark, rows, **options) == brute(rows)


def test_common_vectors_and_empty_table(spark):
    rows = [(i, [0.25, 0.5] if i % 3 else [i / 300, 1.0]) for i in range(300)]
    assert run(spark, rows, block_rows=100) == brute(rows)
    assert run(spark, []) == set()


def index(matrix):
    return topk.Block(np.arange(len(matrix)), matrix)


def test_reading_stops_early():
    """A query whose best vectors lead all lists reads a few entries, and none of another block whose bound is below the carried score."""
    rng = np.random.default_rng(1)
    matrix = rng.integers(-5, 5, (4000, 3))
    matrix[:10] = 900
    block = index(matrix)
    assert block.threshold(-1, np.array([1, 1, 1]), 5, None) == [(2700, i) for i in range(5)]
    assert block.read < 100
    other = index(rng.integers(-5, 5, (4000, 3)))
    assert other.threshold(-1, np.array([1, 1, 1]), 5, 2700) == []
    assert other.read < 30


def test_reading_ends_in_one_product():
    """No more entries are read from lists than there are vectors; then each vector is read once."""
    rng = np.random.default_rng(2)
    block = index(rng.integers(-100, 100, (3000, 40)))
    queries = [(at, rng.integers(-100, 100, 40), None) for at in range(20)]
    found = block.search(queries, 5)
    assert block.read <= 20 * 2 * 3000
    for at, query, _ in queries:
        scores = block.matrix @ query
        best = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != at)[:5]
        assert sorted((-s, i) for q, i, s in found if q == at) == best


def test_the_carried_score_changes_no_result():
    rng = np.random.default_rng(3)
    matrix = rng.integers(-3, 4, (900, 2))
    block = index(matrix)
    for floor in (-5, 0, 10, 17, 18, 19):
        for at in range(30):
            query = rng.integers(-3, 4, 2)
            scores = matrix @ query
            best = sorted((-s, i) for i, s in enumerate(scores.tolist()) if s >= floor and i != at)[:5]
            found = sorted((-s, i) for _, i, s in block.search([(at, query, floor)], 5))
            assert found == best


def test_large_components_are_exact():
    matrix = np.array([[1 << 30, 1], [1 << 30, 2], [(1 << 30) - 1, 3]])
    assert index(matrix).scores(np.array([[(1 << 30) + 1, 1]])).tolist() == [[((1 << 30) + 1) * a + b for a, b in matrix.tolist()]]

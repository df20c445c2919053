"""Exact top-k search by inner product, with Fagin's threshold algorithm.

Candidates are dealt into blocks of bounded size, and each block is indexed once: in each dimension its components are a sorted list.
A query reads its lists from the ends that its signs favour, those with the largest weights furthest, and scores every vector
seen.  No vector that is not seen can score above the bound, the sum of the components reached times the query's.  Reading stops
when the kth best score lies above the bound (above, not at it, as ties go to the smaller id).

The kth best score is carried: a query's first block gives it, and all other blocks start with it, so a block whose bound
falls below that is left after a few reads without a result of its own.  Lists that have been read as far as there are vectors in the
block (all lists taken together) have cost as much as looking at each vector once; then the rest of the block is read in one product for all
such queries.  This is the same answer: every vector is scored.  Vectors of many even dimensions end so, and their cost is that of
the product.

Each block of queries meets each block of candidates by an equi-join on the block number: a stated query set against all
rows, in blocks.  Queries are small and are copied; candidates move once.  The work grows with queries times candidates, the
memory of a task does not.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; a query meets only
vectors of its own length; rows that share a ``vec_id`` are all candidates, except for queries with that id; a null id takes
no part; equal rows of the query set are one query; an empty table gives no rows; other columns are passed over.  Products are exact integers as long as they fit a long; those
below 2^53 are made by floating point, which is exact there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageledger.llm.common import Scratch

#: Candidates and queries of a block; queries whose products with a block are made at once; tasks that pairs of blocks are dealt to at most.
BLOCK_ROWS, QUERY_ROWS, PRODUCT_ROWS, MOST_TASKS = 8_192, 4_096, 64, 50_000
_NO_FLOOR = -(1 << 63)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, v array<bigint>``: each component times ``scale``, rounded down."""
    found = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = F.size("e") > 0
    fine = fine & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return found.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).filter(fine).select("vec_id", F.transform("e", lambda x: F.floor(x * scale)).alias("v"))


class Block:
    """Candidates with their sorted lists."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        self.lists = np.ascontiguousarray(np.argsort(-matrix, axis=0, kind="stable").T)
        self.floats = matrix.astype(np.float64)
        self.most = int(np.abs(matrix).max()) if matrix.size else 0
        self.read = 0  # entries of lists, and vectors read without them

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """Products of queries with all vectors, exact."""
        if self.most * (int(np.abs(queries).max()) if queries.size else 0) * max(1, self.matrix.shape[1]) < 1 << 53:
            return (queries.astype(np.float64) @ self.floats.T).astype(np.int64)
        return queries @ self.matrix.T

    def best(self, scores: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """Places in ``rows`` of the k best, ties to the smaller id."""
        if len(rows) > 4 * k:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = np.flatnonzero(scores >= edge)
            return near[np.lexsort((self.ids[rows[near]], -scores[near]))[:k]]
        return np.lexsort((self.ids[rows], -scores))[:k]

    def threshold(self, query_id: int, query: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]] | None:
        """The best ``(score, id)`` that can matter, or None when the lists have been read as far as there are vectors.

        ``floor`` is a score that k other vectors reach: vectors below it do not matter.
        """
        n, used = len(self.ids), np.flatnonzero(query)
        weights = np.abs(query[used])
        share = weights / weights.sum() if len(used) else weights
        seen, rows, scores = np.zeros(n, bool), np.empty(0, np.int64), np.empty(0, np.int64)
        depth, budget = np.zeros(len(used), np.int64), max(4 * k, len(used))
        total = 0
        while len(used) and total + budget < n:
            reach = np.minimum(depth + np.ceil(share * budget).astype(np.int64), n)
            fresh = []
            for d, a, b in zip(used, depth, reach):
                fresh.append(self.lists[d, a:b] if query[d] > 0 else self.lists[d, n - b : n - a])
            taken = np.concatenate(fresh)
            total += len(taken)
            self.read += len(taken)
            depth, budget = reach, 2 * budget
            taken = np.unique(taken)
            taken = taken[~seen[taken] & (self.ids[taken] != query_id)]
            seen[taken] = True
            rows, scores = np.concatenate([rows, taken]), np.concatenate([scores, self.matrix[taken] @ query])
            top = self.best(scores, rows, k)
            rows, scores = rows[top], scores[top]
            kth = int(scores[-1]) if len(rows) == k else None
            if floor is not None:
                kth = floor if kth is None else max(kth, floor)
            at = np.where(query[used] > 0, self.lists[used, np.maximum(depth, 1) - 1], self.lists[used, n - np.maximum(depth, 1)])
            bound = int(self.matrix[at, used] @ query[used])
            if kth is not None and kth > bound:
                return [(int(s), int(self.ids[r])) for s, r in zip(scores, rows) if floor is None or s >= floor]
        return None

    def search(self, queries: list[tuple[int, np.ndarray, int | None]], k: int) -> list[tuple[int, int, int]]:
        """``(query_id, id, score)`` of the k best that can matter for each query."""
        found, rest = [], []
        for query_id, query, floor in queries:
            best = self.threshold(query_id, query, k, floor)
            if best is None:
                rest.append((query_id, query, floor))
            else:
                found += [(query_id, i, s) for s, i in best]
        rows = np.arange(len(self.ids))
        for at in range(0, len(rest), PRODUCT_ROWS):
            part = rest[at : at + PRODUCT_ROWS]
            self.read += len(part) * len(rows)
            for (query_id, _, floor), scores in zip(part, self.scores(np.array([query for _, query, _ in part]))):
                matter = self.ids != query_id
                if floor is not None:
                    matter &= scores >= floor
                kept = rows[matter]
                top = self.best(scores[kept], kept, k)
                found += [(query_id, int(self.ids[r]), int(scores[r])) for r in kept[top]]
        return found


def _packed(rows: DataFrame, into: int, name: str) -> DataFrame:
    """Rows ``vec_id, v, floor`` dealt into numbered blocks by dimension: ``slot, ids, matrix, floors``, as bytes of longs."""

    def pack(key: tuple, part: pa.Table) -> pa.Table:
        columns = [part.column("vec_id").to_numpy(), pc.list_flatten(part.column("v")).to_numpy(), part.column("floor").to_numpy()]
        made = [pa.array([values.astype("<i8").tobytes()], pa.binary()) for values in columns]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *made], names=[name, "n_dims", "ids", "matrix", "floors"])

    number = F.pmod(F.monotonically_increasing_id(), F.lit(into)).cast("int").alias(name)
    dealt = rows.select(number, F.size("v").alias("n_dims"), "vec_id", "v", "floor")
    return dealt.groupBy(name, "n_dims").applyInArrow(pack, f"{name} int, n_dims int, ids binary, matrix binary, floors binary")


def _searched(blocks: DataFrame, asked: DataFrame, numbers: range, k: int) -> DataFrame:
    """``query_id, vec_id, score``: what the numbered blocks hold for each block of queries."""
    slot = F.concat_ws("/", "block", "n_dims")
    each = asked.withColumn("block", F.explode(F.sequence(F.lit(numbers[0]), F.lit(numbers[-1])))) if len(numbers) > 1 else asked.withColumn("block", F.lit(numbers[0]))
    tasks = 2 * min(len(numbers), MOST_TASKS)
    each = each.select(slot.alias("slot"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("floors").alias("q_floors")).repartition(tasks, "slot")
    rows = blocks.filter(F.col("block").between(numbers[0], numbers[-1])).select(slot.alias("slot"), "ids", "matrix").repartition(tasks, "slot")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                slot_, *data = (batch.column(name)[at].as_py() for name in ("slot", "ids", "matrix", "q_ids", "q_matrix", "q_floors"))
                ids, matrix, q_ids, q_matrix, q_floors = (np.frombuffer(values, "<i8") for values in data)
                if slot_ != known:  # pairs of one block follow one another
                    known, block = slot_, Block(ids, matrix.reshape(len(ids), -1))
                queries = zip(q_ids.tolist(), q_matrix.reshape(len(q_ids), -1), (None if floor == _NO_FLOOR else floor for floor in q_floors.tolist()))
                found = np.array(block.search(list(queries), k), np.int64).reshape(-1, 3).T
                yield pa.RecordBatch.from_arrays([pa.array(values) for values in found], ["query_id", "vec_id", "score"])

    pairs = each.join(rows.hint("merge"), "slot").select("slot", "ids", "matrix", "q_ids", "q_matrix", "q_floors")
    return pairs.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``; both tables hold ``vec_id, v`` of integers."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "top-k")
    n_blocks, n_groups = (max(1, -(-rows.count() // size)) for rows, size in ((vectors, block_rows), (queries, QUERY_ROWS)))
    queries = queries.select("vec_id", "v").dropDuplicates()
    no_floor = F.lit(_NO_FLOOR).cast("bigint")
    blocks = scratch.keep(_packed(vectors.withColumn("floor", no_floor), n_blocks, "block"), "blocks")
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    asked = scratch.keep(_packed(queries.withColumn("floor", no_floor), n_groups, "group"), "queries")
    spark.conf.set(key, "1")  # one pair of blocks in memory at a time
    try:
        found = scratch.keep(_searched(blocks, asked, range(1), k), "first")
    finally:
        spark.conf.set(key, before)
    if n_blocks > 1:
        floors = found.withColumn("_rank", ranked).filter(F.col("_rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        known = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", no_floor))
        asked = scratch.keep(_packed(known, n_groups, "group"), "queries-again")
        spark.conf.set(key, "1")
        try:
            found = found.unionByName(scratch.keep(_searched(blocks, asked, range(1, n_blocks), k), "others"))
        finally:
            spark.conf.set(key, before)
    return found.withColumn("rank", ranked).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

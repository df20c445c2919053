"""Exact deduplication by composable polynomial fingerprints.

The fingerprint of a byte string is its value as a polynomial, modulo two primes.  Fingerprints of neighbouring chunks
combine by length-shifted arithmetic, ``f(ab) = f(a) * base^len(b) + f(b)``, so a huge document is cut into chunks that
any task can hash, and its fingerprint is a sum over them.  Documents with equal fingerprint and length are then compared
chunk by chunk: per place, the distinct chunks of a group are counted with map-side combination, so a group of any size
sends each task's distinct chunks only.  Where a place shows two values the group is divided by them.

Texts are equal when identical after lower-casing A-Z only.  Defined cases: a null text is an empty text, and all empty
texts are equal.  Of equal texts the row with the largest ``doc_id`` stays; null ids come last, and rows that repeat a
``doc_id`` with the same text are one document and share its fate.  An empty table gives an empty result.  Columns
beyond ``doc_id`` and ``text`` are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageledger.llm.common import Scratch, raw_hash, text_bytes

MODULI = (2147483647, 2147483629)
BASES = (1000003, 69621113)
#: Bytes of a chunk, and the length from which a document's chunks are hashed as rows of their own.
CHUNK_BYTES, HUGE_BYTES = 1 << 16, 8 << 20


class Polynomial:
    """Chunk hashes and their combination."""

    def __init__(self, chunk: int = CHUNK_BYTES, moduli: tuple[int, int] = MODULI):
        self.chunk, self.moduli = chunk, moduli
        self.powers = []
        for base, modulus in zip(BASES, moduli, strict=True):
            powers = np.ones(chunk, np.uint64)
            for at in range(1, chunk):
                powers[at] = int(powers[at - 1]) * base % modulus
            self.powers.append(powers[::-1].copy())

    def of_chunk(self, data: np.ndarray) -> tuple[int, int]:
        """The value of at most ``chunk`` bytes; each byte counts as one more, so leading zeros matter."""
        digits = data.astype(np.uint64) + np.uint64(1)
        first, second = (int(np.dot(digits, powers[self.chunk - len(digits) :])) % modulus for powers, modulus in zip(self.powers, self.moduli))
        return first, second

    def combine(self, left: tuple[int, int], right: tuple[int, int], right_length: int) -> tuple[int, int]:
        first, second = ((a * pow(base, right_length, m) + b) % m for a, b, base, m in zip(left, right, BASES, self.moduli))
        return first, second

    def of(self, data: bytes) -> tuple[int, int]:
        body, value = np.frombuffer(data, np.uint8), (0, 0)
        for at in range(0, len(body), self.chunk):
            piece = body[at : at + self.chunk]
            value = self.combine(value, self.of_chunk(piece), len(piece))
        return value


def fingerprints(docs: DataFrame, chunk: int = CHUNK_BYTES, huge: int = HUGE_BYTES, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """``doc_id, fp, n_bytes, text_sha256`` of the normalised text of each row, and ``raw``, a hash of the text as it is."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Polynomial(chunk, moduli)
        for batch in batches:
            fps, sizes, shas = [], [], []
            for value in batch.column(1):
                text = value.as_py().lower()
                first, second = hasher.of(text)
                fps.append(first << 31 | second)
                sizes.append(len(text))
                shas.append(hashlib.sha256(text).hexdigest())
            columns = [batch.column(0), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "n_bytes", "text_sha256", "raw"])

    def shares(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Polynomial(chunk, moduli)
        for batch in batches:
            first, second = [], []
            for value, after in zip(batch.column(4), batch.column(3)):
                part = hasher.of_chunk(np.frombuffer(value.as_py().lower(), np.uint8))
                part = hasher.combine(part, (0, 0), after.as_py())
                first.append(part[0])
                second.append(part[1])
            columns = [*batch.columns[:3], *batch.columns[5:7], pa.array(first, pa.int64()), pa.array(second, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "n_bytes", "text_sha256", "raw", "f1", "f2"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("body"), raw_hash().alias("raw"))
    result = "doc_id bigint, fp bigint, n_bytes bigint, text_sha256 string, raw bigint"
    small = rows.filter(F.octet_length("body") <= huge).mapInArrow(whole, result)
    size = F.octet_length("body").cast("bigint")
    upper = "".join(map(chr, range(65, 91)))
    large = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), text_bytes().alias("body"))
    large = large.filter(F.octet_length("body") > huge).select(
        F.monotonically_increasing_id().alias("uid"),
        "doc_id",
        size.alias("n_bytes"),
        "body",
        F.sha2(F.translate("text", upper, upper.lower()), 256).alias("text_sha256"),
        raw_hash().alias("raw"),
    )
    pieces = large.withColumn("at", F.explode(F.expr(f"sequence(0L, n_bytes - 1, {chunk}L)"))).select(
        "uid",
        "doc_id",
        "n_bytes",
        F.greatest(F.col("n_bytes") - F.col("at") - chunk, F.lit(0)).alias("after"),
        F.expr(f"substring(body, int(at + 1), {chunk})").alias("piece"),
        "text_sha256",
        "raw",
    )
    hashed = pieces.repartition("uid", "after").mapInArrow(shares, "uid bigint, doc_id bigint, n_bytes bigint, text_sha256 string, raw bigint, f1 bigint, f2 bigint")
    summed = hashed.groupBy("uid", "doc_id", "n_bytes", "text_sha256", "raw").agg(F.sum("f1").alias("f1"), F.sum("f2").alias("f2"))
    value = F.shiftleft(F.col("f1") % moduli[0], 31).bitwiseOR(F.col("f2") % moduli[1])
    return small.unionByName(summed.select("doc_id", value.alias("fp"), "n_bytes", "text_sha256", "raw"))


def _chunks(docs: DataFrame, groups: DataFrame, chunk: int, moduli: tuple[int, int]) -> DataFrame:
    """The normalised chunks of the documents whose fingerprint several rows share."""

    def normalised(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Polynomial(chunk, moduli)
        for batch in batches:
            texts = [value.as_py().lower() for value in batch.column(1)]
            values = [hasher.of(text) for text in texts]
            columns = [
                batch.column(0),
                pa.array([a << 31 | b for a, b in values], pa.int64()),
                pa.array([len(text) for text in texts], pa.int64()),
                pa.array([hashlib.sha256(text).hexdigest() for text in texts], pa.string()),
                pa.array(texts, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "n_bytes", "text_sha256", "body"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("body"))
    shared = rows.mapInArrow(normalised, "doc_id bigint, fp bigint, n_bytes bigint, text_sha256 string, body binary")
    return (
        shared.join(groups, ["fp", "n_bytes"], "left_semi")
        .withColumn("at", F.explode(F.expr(f"sequence(0L, greatest(n_bytes - 1, 0L), {chunk}L)")))
        .select("doc_id", "fp", "n_bytes", "text_sha256", "at", F.expr(f"substring(body, int(at + 1), {chunk})").alias("piece"))
    )


def exact_duplicates(docs: DataFrame, chunk: int = CHUNK_BYTES, huge: int = HUGE_BYTES, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, n_bytes, raw`` of each row."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    slim = scratch.keep(fingerprints(docs, chunk, huge, moduli), "fingerprints").withColumn("part", F.lit(""))
    key = ["fp", "n_bytes", "part"]
    groups = slim.groupBy("fp", "n_bytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    pieces = _chunks(docs, groups, chunk, moduli)
    place = ["fp", "n_bytes", "at"]
    values = pieces.groupBy(*place, "piece").agg(F.min("text_sha256").alias("least"))
    counted = scratch.keep(values.groupBy(*place).agg(F.count(F.lit(1)).alias("values")), "compared")
    clash = counted.filter("values > 1").select("fp", "n_bytes").distinct()
    if not clash.isEmpty():
        apart = pieces.join(clash, ["fp", "n_bytes"], "left_semi").select(*place, "piece", "text_sha256").distinct()
        named = apart.join(values, [*place, "piece"]).groupBy("fp", "n_bytes", "text_sha256")
        parts = named.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "least"))), lambda x: x["least"]), ","), 256).alias("found"))
        slim = slim.drop("part").join(parts, ["fp", "n_bytes", "text_sha256"], "left").withColumn("part", F.coalesce("found", F.lit(""))).drop("found")
    kept = slim.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return slim.join(kept, key).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_bytes", "raw"
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat an id and a text one stays."""
    scratch = Scratch(docs.sparkSession, "exact-dedup-rows")
    found = scratch.keep(exact_duplicates(docs), "duplicates")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__dedup_id")) & (raw_hash() == F.col("__dedup_raw"))
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("__dedup_id"), F.col("raw").alias("__dedup_raw")).distinct()
    kept = docs.join(scratch.keep(gone, "gone"), same, "left_anti")
    again = found.filter("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.collect_set("raw").alias("raws")).filter("n > 1")
    again = scratch.keep(again.select(F.col("doc_id").alias("__dedup_id"), F.explode("raws").alias("__dedup_raw"), F.col("text_sha256").alias("__dedup_sha")), "again")
    if again.isEmpty():
        return kept
    once = kept.join(again, same).dropDuplicates(["__dedup_id", "__dedup_sha"]).select(*[F.col(f"`{name}`") for name in docs.columns])
    return kept.join(again, same, "left_anti").unionByName(once)

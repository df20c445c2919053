"""What several of the operators share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageledger.session import checkpoint_dir

#: Bytes of text that a task works on at once; bounds the numpy arrays made from them.
SLICE_BYTES = 4 << 20

_BASE, _MIX = 0x9E3779B97F4A7C15 | 1, np.uint64(0xD6E8FEB86659FD93)
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Scratch:
    """One run's folder below the shared checkpoint folder.

    Tables written to it are read back with exact sizes and no lineage, so a lost executor costs a task.  ``drop`` removes
    only what this run wrote.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, a finished query gives back its shuffle files at once, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text; null is empty."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b""))


def raw_hash(column: str = "text") -> Column:
    """With the id it tells rows apart that share one; null is empty."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string Arrow array without nulls, end to end, and where each value starts and ends."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body, offsets.astype(np.int64)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole values of about ``limit`` bytes; a longer value stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in the least number of bytes that holds them, byte place by byte place, compressed."""
    top = int(values.max()) if len(values) else 0
    width = max(1, -(-top.bit_length() // 8))
    places = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(places).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    places = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    width = next(w for w in (1, 2, 4, 8) if w >= data[0])
    values = np.zeros((places.shape[1], width), np.uint8)
    values[:, : data[0]] = places.T
    return values.view(f"<u{width}").ravel()


@lru_cache(2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64.  With prefix sums over the first, the hash of any span is a difference
    times the second at its start."""
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(29))


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Partitions of mixed hashes; they rise with the hash."""
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)

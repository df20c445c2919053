"""Dense numbering inside each site without gathering a site in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageledger.session import cut


def in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Add ``block`` and ``local``, a number that is dense inside the row's key and block.

    Blocks are range partitions: they follow the order and are of even size however the rows spread over keys,
    parents or documents.  Rows are sorted where they lie, so this is one shuffle.  The order must be total.  Write the result before
    using it twice, as another run may draw other block borders.
    """
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return ranged.withColumn("block", F.spark_partition_id()).withColumn("local", F.monotonically_increasing_id())


def block_starts(numbered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and block: ``_start``, which makes ``local`` a number inside the key, and ``_total``, the key's rows."""
    sizes = numbered.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("_size"), F.min("local").alias("_least"))
    whole = W.partitionBy(*keys)
    before = whole.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_least") + 1
    return sizes.select(*keys, "block", start.alias("_start"), F.sum("_size").over(whole).alias("_total"))


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str, name: str) -> DataFrame:
    """Number the rows of each key from 1 in the given total order.

    Only one row per block is summed up per key, and the block table is joined back, so a key with a third of all rows is never one
    task's work.
    """
    blocks = cut(in_blocks(df, keys, order), name)
    joined = blocks.join(block_starts(blocks, keys), [*keys, "block"])
    return joined.withColumn(out, F.col("_start") + F.col("local")).drop("_start", "_total", "block", "local")

"""Spark session helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir`` or has set it on the context already.  A local session
    without either gets a folder of its own; anything else is an error, as executors must all reach the folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    folder = tempfile.mkdtemp(prefix="pageledger-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back.

    This ends the lineage, survives lost executors, and gives the next join exact file sizes to plan with.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filter_in_place(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on columns that were costly to make, without making them twice.

    Catalyst pushes a filter below the projection that computes its columns, by copying the computation into the
    filter.  For fields parsed out of page text that doubles the parsing.  A filter that also mentions a
    non-deterministic column has to stay where it is.
    """
    return df.withColumn("_row", F.monotonically_increasing_id()).filter(condition & (F.col("_row") >= 0)).drop("_row")

"""From raw documents to packed training sequences.

Each stage takes what the one before it kept, read back from the table it was written to.  The first four return documents with the
columns they came with; the last returns the pieces with their ids and their places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageledger.llm import exact_dedup, packing, pii, simhash, toxicity
from pageledger.llm.common import Scratch, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup.drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints the document with the smallest id stays."""
    return simhash.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with labels in the place of personal data and of the terms that give it away."""
    whole = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    changed = {"text": F.col("sanitised"), "n_chars": F.length("sanitised").cast("bigint")}
    columns = [changed[name] if name in changed else F.col("row").getField(name) for name in docs.columns]
    return pii.sanitise(whole).select(*[column.alias(name) for name, column in zip(docs.columns, columns)])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces with their ids and places; the checksum is that of the packed ids."""
    return packing.pack(packing.pieces_of(docs).drop("ids_crc32")).withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("pii_sanitisation", without_personal_data),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs


#: Models, fingerprints and packing are beyond SQL; the tests hold the stages against plain Python.
ORACLE_SQL: str | None = None

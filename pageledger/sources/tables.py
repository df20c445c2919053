"""Readers for the input tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageledger import fixed_values as fixed
from pageledger import schemas
from pageledger.operators import state_log
from pageledger.operators.changeset import Target


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page snapshots ``(url, html)`` with optional ``site`` and ``status``."""
    return spark.read.parquet(path)


def read_sitemap_docs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SITEMAP_DOCS).parquet(path)


def read_robots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ROBOTS).parquet(path)


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as ``(file, body)``, for sitemaps or robots files kept as files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))


def read_responses(spark: SparkSession, path: str, source_format: str = "json") -> DataFrame:
    return spark.read.schema(schemas.RESPONSES).format(source_format).load(path)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EXISTING_TAGS).parquet(path)


def read_state(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """Earlier page records, one for each address.  No state yet means an empty table.  One site is found by its bucket alone."""
    if site is None:
        return state_log.read(spark, path)
    bucket = spark.range(1).select(state_log.site_bucket(F.lit(site))).head()[0]
    return state_log.read(spark, path, [bucket]).filter(F.col("site") == site)


def target_from_config(config: dict) -> Target:
    """The target of a configuration: the ``aem`` entry if there is one, else the first.  Credentials are ignored."""
    name = fixed.DEFAULT_TARGET if fixed.DEFAULT_TARGET in config else next(iter(config))
    entry = config[name]
    return Target(
        type=entry.get("type"),
        author_url=entry.get("authorUrl"),
        site_path_prefix=entry.get("sitePathPrefix"),
        replicate_after_update=bool(entry.get("replicateAfterUpdate")),
        property_map=entry.get("propertyMap"),
        update_fields=tuple(entry.get("updateFields") or ()),
        tag_namespace=entry.get("tagNamespace"),
        tag_namespace_map=tuple((entry.get("tagNamespaceMap") or {}).items()),
    )


def load_target(spark: SparkSession, path: str) -> Target:
    """Read a target configuration, a small JSON file."""
    return target_from_config(json.loads(spark.read.text(path, wholetext=True).head()[0]))

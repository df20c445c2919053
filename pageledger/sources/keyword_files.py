"""Keyword exports with differing headers, and their materialised table."""

from __future__ import annotations

import csv
import io
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageledger import schemas
from pageledger.operators.keywords import clean_keywords, detect_columns, metric
from pageledger.session import cut
from pageledger.sources.records import quoted_records


#: Columns that are added to a file's own, whose names cannot be foreseen.
_FILE, _ROW = "__keyword_file", "__keyword_row"
_FORMAT = {"escape": '"', "multiLine": "true"}


def _metrics(rows: DataFrame, headers: list[str], columns: list[str]) -> DataFrame | None:
    """Metric rows of files that share ``headers``, whose cells are in ``columns``; None when no column holds keywords."""
    keyword, clicks, impressions = (None if name is None else columns[headers.index(name)] for name in detect_columns(headers))
    if keyword is None:
        return None

    def quoted(name: str | None) -> str | None:
        return None if name is None else "`" + name.replace("`", "``") + "`"

    return clean_keywords(
        rows.select(
            F.col(_FILE).alias("file"),
            F.lit(0).alias("sheet_pos"),
            F.col(_ROW).alias("row_pos"),
            F.col(quoted(keyword)).cast("string").alias("keyword"),
            metric(quoted(clicks)).alias("clicks"),
            metric(quoted(impressions)).alias("impressions"),
        )
    )


def _delimited(spark: SparkSession, paths: list[str]) -> list[DataFrame | None]:
    """Rows of delimited files, by header.  One header a file comes to the driver; its cells may hold line breaks."""
    records = cut(quoted_records(spark, paths), "keyword-records")
    first = records.groupBy("file").agg(F.min("row_pos").alias("row_pos"))
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in records.join(first, ["file", "row_pos"]).orderBy("file").collect():
        header = tuple(next(csv.reader(io.StringIO(row["record"], newline="")), ()))
        groups.setdefault(header, []).append(row["file"])
    body = records.join(first.withColumnRenamed("row_pos", "_header"), "file").filter(F.col("row_pos") > F.col("_header"))
    found = []
    for header, files in groups.items():
        columns = [f"c{at}" for at in range(len(header))]
        cells = F.from_csv("record", ", ".join(f"{name} string" for name in columns), _FORMAT).alias("cells")
        rows = body.filter(F.col("file").isin(*files)).select(F.col("file").alias(_FILE), F.col("row_pos").alias(_ROW), cells)
        found.append(_metrics(rows.select(_FILE, _ROW, "cells.*"), list(header), columns))
    return found


def _placed(rows: DataFrame) -> DataFrame:
    """Add the file and a number that grows with the row's place in its file."""
    return rows.select("*", F.col("_metadata.file_path").alias(_FILE), F.monotonically_increasing_id().alias(_ROW))


def read_keyword_files(spark: SparkSession, paths: list[str], source_format: str = "csv") -> DataFrame:
    """All keyword rows of the files, whatever their headers; files without a keyword column are skipped.

    Quoted cells may hold line breaks, and a large file is still read by many tasks.
    """
    if not paths:
        return spark.createDataFrame([], schemas.KEYWORD_METRICS)
    if source_format == "csv":
        tables = _delimited(spark, paths)
    else:
        loaded = [_placed(spark.read.format(source_format).load(path)) for path in paths]
        names = [[name for name in rows.columns if name not in (_FILE, _ROW)] for rows in loaded]
        tables = [_metrics(rows, own, own) for rows, own in zip(loaded, names)]
    found = [rows for rows in tables if rows is not None]
    if not found:
        return spark.createDataFrame([], schemas.KEYWORD_METRICS)
    return reduce(DataFrame.unionByName, found)


def _modified(spark: SparkSession, paths: list[str], newest: bool):
    """Newest or oldest modification time; file contents are not read."""
    pick = F.max if newest else F.min
    return spark.read.format("binaryFile").load(paths).agg(pick("modificationTime")).head()[0]


def materialise_keywords(spark: SparkSession, paths: list[str], path: str, source_format: str = "csv") -> DataFrame:
    """The keyword table at ``path``, rebuilt unless it is newer than every source file."""
    try:
        stored = _modified(spark, [path], newest=False)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = None
    latest = _modified(spark, paths, newest=True) if paths else None
    if stored is None or (latest is not None and stored <= latest):
        read_keyword_files(spark, paths, source_format).write.mode("overwrite").parquet(path)
    return spark.read.schema(schemas.KEYWORD_METRICS).parquet(path)

"""Counts per site kept beside the state log, so that a summary needs no reading of the state.

Every segment of the log adds one small table of differences, ``upto=N/base=false``, a row for each site that the run touched: the counts
of its records less those of the records they supersede, which are the earlier ones of the same addresses, or of the same sites where a
run replaces them.  Sums of differences are the summary of the state.  Only the buckets that a segment holds are read for it.

``update`` counts the segments that are not counted yet, in order, and may be called again after a failure at any point.  Call it before
``state_log.compact``: rewriting keeps no superseded records, so if a run was rewritten before it was counted, the counts are made anew from
the state and written as ``base=true``, which ends what is below.  Many differences are added up to a base as well.

Defined cases: a null site is a site like any other; a run without records changes nothing; a site without records left has no row; no
state gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageledger.operators import state_log
from pageledger.operators.state_log import Segment
from pageledger.operators.summary import COUNTS, audit_summary

#: Tables of differences from which on they are added up.
MANY_DIFFERENCES = 16

_SCHEMA = T.StructType([T.StructField("site", T.StringType())] + [T.StructField(name, T.LongType()) for name in COUNTS])


def _parts(spark: SparkSession, path: str) -> list[tuple[int, bool, str]]:
    """The whole tables that count: the last base and the differences after it."""
    found = []
    for name in state_log.names(spark, path):
        for kind in state_log.names(spark, f"{path}/{name}"):
            if "_SUCCESS" in state_log.names(spark, f"{path}/{name}/{kind}"):
                found.append((int(name.removeprefix("upto=")), kind == "base=true", f"{path}/{name}/{kind}"))
    found.sort()
    last = max((at for at, (_, base, _) in enumerate(found) if base), default=0)
    return found[last:]


def _write(counts: DataFrame, path: str, number: int, base: bool) -> None:
    columns = [F.col(field.name).cast(field.dataType).alias(field.name) for field in _SCHEMA]
    counts.select(*columns).write.mode("overwrite").parquet(f"{path}/upto={number}/base={str(base).lower()}")


def _added(counts: DataFrame) -> DataFrame:
    return counts.groupBy("site").agg(*[F.sum(name).alias(name) for name in COUNTS])


def _difference(spark: SparkSession, state: str, whole: list[Segment], segment: Segment) -> DataFrame:
    """Counts of a segment's records less those of the records that it supersedes."""
    new = state_log.stored(spark, state, [segment], segment.buckets)
    counts = audit_summary(new)
    earlier = [s for s in whole if s.number < segment.number and set(s.buckets) & set(segment.buckets)]
    if not earlier:
        return counts
    before = state_log.latest(state_log.stored(spark, state, earlier, segment.buckets), earlier)
    same = F.col("site").eqNullSafe(F.col("_site"))
    keys = [F.col("site").alias("_site")]
    if not segment.replaces:
        same = same & F.col("url").eqNullSafe(F.col("_url"))
        keys.append(F.col("url").alias("_url"))
    superseded = audit_summary(before.join(new.select(*keys).distinct(), same, "left_semi"))
    less = superseded.select("site", *[(-F.col(name)).alias(name) for name in COUNTS])
    return _added(counts.unionByName(less))


def update(spark: SparkSession, state: str, path: str, many: int = MANY_DIFFERENCES) -> None:
    """Count the segments of the log at ``state`` that the counts at ``path`` do not hold yet."""
    whole = state_log.segments(spark, state)
    done = max((number for number, _, _ in _parts(spark, path)), default=0)
    for segment in whole:
        if segment.number <= done or not segment.buckets:
            continue
        # a rewritten bucket keeps the versions of its records
        moved = state_log.stored(spark, state, [segment], segment.buckets).filter(F.col("version") != segment.number)
        if moved.filter(F.col("version") > done).isEmpty():
            if moved.isEmpty():
                _write(_difference(spark, state, whole, segment), path, segment.number, False)
            continue
        _write(audit_summary(state_log.read(spark, state)), path, whole[-1].number, True)
        break
    parts = _parts(spark, path)
    if len(parts) >= many:
        _write(_added(spark.read.schema(_SCHEMA).parquet(*[folder for _, _, folder in parts])), path, parts[-1][0], True)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The summary of the state, as ``audit_summary`` would give it."""
    parts = _parts(spark, path)
    if not parts:
        return spark.createDataFrame([], _SCHEMA)
    return _added(spark.read.schema(_SCHEMA).parquet(*[folder for _, _, folder in parts])).filter("total_pages > 0")

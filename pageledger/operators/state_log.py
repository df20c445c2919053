"""The state of all runs as a log of segments, merged when it is read.

A run adds one numbered segment, ``segment=N/replaces=B/site_bucket=K`` below the state's folder, and changes nothing that is there.
A segment counts once Spark has marked it as whole, so a run that failed leaves nothing behind that is read.  A record's
``version`` is the number of the segment it was first written to:

* Of the records of an address the one with the latest version counts.  A forced run may thus record addresses again.
* A run that replaces a site's records (``replaces``) ends what earlier segments say of the sites it holds.

Addresses that were recorded once stay where they are when the log is read: the numbers of versions, two longs an address, tell
which were recorded again, and only the rows of these are picked from.

``compact`` rewrites the buckets that many segments hold, and no others, into one segment, with their versions, and then removes the
superseded folders, oldest first.  If it stops in between, rows are there twice with the same version, and the later segment's
count.  Run it while nothing else reads the state.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageledger import schemas

STATE_BUCKETS = 256
#: Segments of a bucket from which on it is worth rewriting.
MANY_SEGMENTS = 8

_SEGMENTS = 1 << 31
_STORED = T.StructType(
    schemas.CRAWL_STATE.fields
    + [T.StructField("version", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("replaces", T.BooleanType()), T.StructField("site_bucket", T.IntegerType())]
)


def site_bucket(site: Column, buckets: int = STATE_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(site), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Segment:
    number: int
    replaces: bool
    path: str
    buckets: tuple[int, ...]


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    folder, system = _folder(spark, path)
    return sorted(status.getPath().getName() for status in system.listStatus(folder)) if system.exists(folder) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all segments, whole or not."""
    return sorted(int(name.removeprefix("segment=")) for name in names(spark, path) if name.startswith("segment="))


def segments(spark: SparkSession, path: str) -> list[Segment]:
    """The whole segments in order.  Folder names only are listed, at most one for each bucket of a segment."""
    found = []
    for number in _numbers(spark, path):
        for kind in names(spark, f"{path}/segment={number}"):
            below = f"{path}/segment={number}/{kind}"
            inside = names(spark, below) if kind.startswith("replaces=") else []
            if "_SUCCESS" in inside:
                buckets = tuple(int(name.removeprefix("site_bucket=")) for name in inside if name.startswith("site_bucket="))
                found.append(Segment(number, kind == "replaces=true", below, buckets))
    return found


def append(records: DataFrame, path: str, replaces: bool = False) -> int:
    """Write a run's records as the next segment, and return its number.

    Partitioned by a hash of the site: the folder count stays fixed with any number of sites, and the rebalance hint lets AQE split the
    partition of a very large site and merge those of small ones.  ``replaces`` ends the earlier records of the sites.
    """
    number = max(_numbers(records.sparkSession, path), default=0) + 1
    dated = records if "crawl_date" in records.columns else records.withColumn("crawl_date", F.current_timestamp())
    given = set(dated.columns)
    columns = [(F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.CRAWL_STATE]
    _write(dated.select(*columns, F.lit(number).cast("bigint").alias("version")), path, number, replaces)
    return number


def _write(rows: DataFrame, path: str, number: int, replaces: bool) -> None:
    bucketed = rows.withColumn("site_bucket", site_bucket(F.col("site")))
    below = f"{path}/segment={number}/replaces={str(replaces).lower()}"
    bucketed.hint("rebalance", "site_bucket").write.mode("errorifexists").partitionBy("site_bucket").parquet(below)


def stored(spark: SparkSession, path: str, whole: list[Segment], buckets: Collection[int]) -> DataFrame:
    """The rows of the buckets; the folders of others are not even listed."""
    wanted = [f"{s.path}/site_bucket={bucket}" for s in whole for bucket in s.buckets if bucket in buckets]
    return spark.read.schema(_STORED).option("basePath", path).parquet(*wanted)


def latest(rows: DataFrame, whole: list[Segment]) -> DataFrame:
    """Of the rows of each address the one that counts; also keeps the helper columns."""
    if any(s.replaces for s in whole):
        ends = rows.filter("replaces").groupBy(F.col("site").alias("_site")).agg(F.max("version").alias("_from"))
        rows = rows.join(ends, F.col("site").eqNullSafe(F.col("_site")), "left").filter(F.col("_from").isNull() | (F.col("version") >= F.col("_from"))).drop("_site", "_from")
    if len(whole) < 2:
        return rows
    place = F.col("version") * F.lit(_SEGMENTS) + F.col("segment")
    slim = rows.groupBy(F.col("site").alias("_site"), F.col("url").alias("_url")).agg(F.max(place).alias("_top"), F.count(F.lit(1)).alias("_n"))
    again = slim.filter("_n > 1").drop("_n")
    same = F.col("site").eqNullSafe(F.col("_site")) & F.col("url").eqNullSafe(F.col("_url"))
    return rows.join(again, same, "left").filter(F.col("_top").isNull() | (place == F.col("_top"))).drop("_site", "_url", "_top")


def read(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The records that count.  No state yet means an empty table; ``buckets`` are all that is read of it."""
    whole = [s for s in segments(spark, path) if s.buckets and (buckets is None or set(s.buckets) & set(buckets))]
    if not whole:
        return spark.createDataFrame([], schemas.CRAWL_STATE)
    rows = stored(spark, path, whole, range(STATE_BUCKETS) if buckets is None else set(buckets))
    return latest(rows, whole).select(*schemas.CRAWL_STATE.names)


def compact(spark: SparkSession, path: str, many: int = MANY_SEGMENTS) -> list[int]:
    """Rewrite the buckets that ``many`` segments or more hold as one segment each, and return them."""
    whole = segments(spark, path)
    held: dict[int, list[Segment]] = defaultdict(list)
    for s in whole:
        for bucket in s.buckets:
            held[bucket].append(s)
    full = sorted(bucket for bucket, of in held.items() if len(of) >= many)
    if not full:
        return []
    number = max(_numbers(spark, path)) + 1
    rows = stored(spark, path, whole, set(full))
    _write(latest(rows, whole).select(*schemas.CRAWL_STATE.names, "version"), path, number, False)
    for s in whole:
        for bucket in set(s.buckets) & set(full):
            folder, system = _folder(spark, f"{s.path}/site_bucket={bucket}")
            system.delete(folder, True)
    return full

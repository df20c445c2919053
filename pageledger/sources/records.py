"""Records of delimited files whose quoted cells may hold line breaks, read by many tasks.

A line break belongs to a cell when the number of quotes before it is odd.  Each split of a file is read by itself, and its quotes are
counted; running sums over the splits of a file, one row each, tell whether a split begins inside a cell, and running sums in a split
tell it for each line.  Lines outside of cells begin records.  A record of one line stays where it is; only the lines of records that
go over a break are brought together, also where they lie in different splits.

A quote that is never closed makes the rest of its file one record, as a reader of the whole file would have it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageledger.session import cut


def quoted_records(spark: SparkSession, paths: list[str], quote: str = '"') -> DataFrame:
    """``file, row_pos, record``: the text of each record without its last line break; ``row_pos`` rises with its place in the file.

    Lines end with a line feed; a carriage return before the one that ends a record is dropped, others are kept.  Blank lines between records
    are none.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        (F.length("value") - F.length(F.replace("value", F.lit(quote)))).alias("quotes"),
        F.col("value").alias("line"),
    )
    # numbered in their split; the number of a line is at most its distance from the split's start in bytes
    split = W.partitionBy("file", "block")
    before = split.orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    placed = lines.withColumns({"n": F.row_number().over(split.orderBy("at")) - 1, "_before": F.coalesce(F.sum("quotes").over(before), F.lit(0))})
    placed = cut(placed.select("file", "block", (F.col("block") + F.col("n")).alias("pos"), "_before", "quotes", "line"), "lines")
    # a split has two possible readings; which holds is known when the splits before it are counted
    odd = F.col("_before") % 2
    splits = placed.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"), F.max(F.when(odd == 0, F.col("pos"))).alias("last_even"), F.max(F.when(odd == 1, F.col("pos"))).alias("last_odd")
    )
    in_file = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("inside", F.coalesce(F.sum("quotes").over(in_file), F.lit(0)) % 2)
    splits = splits.withColumn("last", F.when(F.col("inside") == 0, F.col("last_even")).otherwise(F.col("last_odd")))
    splits = cut(splits.select("file", "block", "inside", F.max("last").over(in_file).alias("open")), "splits")
    known = placed.join(splits, ["file", "block"])
    begins = (F.col("_before") + F.col("inside")) % 2 == 0
    ends = (F.col("_before") + F.col("quotes") + F.col("inside")) % 2 == 0
    known = known.select("file", "block", "pos", "line", "open", begins.alias("begins"), ends.alias("ends"))
    single = known.filter("begins AND ends").select("file", F.col("pos").alias("row_pos"), F.col("line").alias("record"))
    parts = known.filter("NOT (begins AND ends)")
    # the first line of a record lies in this split or is the last that began one in an earlier split
    running = W.partitionBy("file", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = parts.withColumn("row_pos", F.coalesce(F.max(F.when(F.col("begins"), F.col("pos"))).over(running), F.col("open")))
    gathered = parts.groupBy("file", "row_pos").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    whole = gathered.select("file", "row_pos", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("record"))
    records = single.unionByName(whole).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    records = records.withColumn("record", F.when(F.col("row_pos") == 0, F.regexp_replace("record", r"\A\x{FEFF}", "")).otherwise(F.col("record")))
    return records.filter(F.trim("record") != "")

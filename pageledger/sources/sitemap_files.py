"""Entries of sitemap files of any size, read by many tasks.

A file is read in pieces that end with ``</url>``, which Spark deals out by splits, so an entry is parsed where its split is read.  Each
piece is parsed as a document of its own: the first with the file's own beginning, the others below a root that is put before them.

Entries may be commented out, and a comment may go over many pieces.  Comments cannot hold others, so a piece lies in one when more of
them have begun than ended before it; running sums over a split, and over one row for each split, tell.  What they hold is dropped
before the pieces of an entry are brought together, so no row grows with a comment.  Only files in which a comment holds a border of
pieces need this; the pieces of all others stay where they are.

A document is sound when all its pieces are.  One that is not (it is malformed, or has ``</url>`` where no entry of its root ends) is
put together again and read as one value, as ``parse_urlset`` does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageledger.operators.numbering import number_rows
from pageledger.operators.sitemap import looks_like_xml, parse_document, parse_urlset, sitemap_kind
from pageledger.session import cut

_END = "</url>"
#: Characters up to which an unsound document is read as one value; the protocol allows 50 MB.
WHOLE_LENGTH = 1 << 28
_ATTRIBUTES = ("lastmod", "priority", "changefreq")


def read_urlset_files(spark: SparkSession, paths: list[str], whole_length: int = WHOLE_LENGTH) -> DataFrame:
    """``file, pos, url, lastmod, priority, changefreq`` of ``urlset`` files in UTF-8; ``pos`` is dense from 0 in a file.

    Entries without ``loc`` are dropped.  Malformed files, index files, files that are no XML and empty files give none, and neither does
    an unsound file of more than ``whole_length`` characters.
    """
    pieces = cut(_pieces(spark, paths), "sitemap-pieces")
    parsed = cut(_parsed(_without_comments(pieces)), "sitemap-entries")
    place = F.struct("block", "at")
    files = parsed.groupBy("file").agg(
        F.min_by("kind", place).alias("kind"),
        F.min("sound").alias("sound"),
        # the beginning and the end of the document are in its first and its last piece, and nowhere else
        (F.min(F.when(F.col("begins"), place)) == F.min(place)).alias("begun"),
        (F.max(F.when(F.col("begins"), place)) == F.min(place)).alias("once"),
        (F.min(F.when(F.col("ends"), place)) == F.max(place)).alias("ended"),
    )
    sound = F.coalesce(F.expr("sound AND begun AND once AND ended"), F.lit(False))
    files = cut(files.filter("kind = 'urlset'").select("file", sound.alias("sound")), "sitemap-files")
    entries = parsed.filter(F.col("entry").isNotNull()).join(files.filter("sound"), "file", "left_semi")
    numbered = number_rows(entries.select("file", "block", "at", "k", "entry"), ["file"], ["block", "at", "k"], "pos", "sitemap-places")
    attributes = [F.nullif(F.col(f"entry.{name}"), F.lit("")).alias(name) for name in _ATTRIBUTES]
    read = numbered.select("file", (F.col("pos") - 1).alias("pos"), F.col("entry.loc").alias("url"), *attributes)
    return read.unionByName(parse_urlset(_whole(pieces, files.filter("NOT sound"), whole_length)).withColumn("pos", F.col("pos").cast("bigint")))


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, block, at, piece``; ``block`` and ``at`` tell the order in a file."""
    return spark.read.option("lineSep", _END).text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("piece"),
    )


def _without_comments(pieces: DataFrame) -> DataFrame:
    """The same pieces, without comments where these hold borders; ``odd`` where comments do not begin and end in turn."""
    depth = F.regexp_count("piece", F.lit("<!--")) - F.regexp_count("piece", F.lit("-->"))
    marked = cut(pieces.withColumn("more", depth).filter("more <> 0").select("file").distinct(), "sitemap-commented")
    plain = pieces.join(marked, "file", "left_anti").withColumn("odd", F.lit(False))
    split = W.partitionBy("file", "block")
    before = split.orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    placed = pieces.join(marked, "file", "left_semi").withColumn("more", depth)
    placed = cut(placed.withColumn("begun", F.coalesce(F.sum("more").over(before), F.lit(0))), "sitemap-placed")
    # a split begins outside of comments or in one; which holds, and how many borders then count, is known from the splits before it
    after = F.col("begun") + F.col("more")
    splits = placed.groupBy("file", "block").agg(
        F.sum("more").alias("more"), F.count_if(after == 0).alias("borders"), F.count_if(after == -1).alias("borders_inside")
    )
    in_file = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("inside", F.coalesce(F.sum("more").over(in_file), F.lit(0)))
    borders = F.when(F.col("inside") == 0, F.col("borders")).otherwise(F.col("borders_inside"))
    splits = cut(splits.select("file", "block", "inside", F.coalesce(F.sum(borders).over(in_file), F.lit(0)).alias("start")), "sitemap-splits")
    known = placed.join(splits, ["file", "block"]).withColumn("depth", F.col("begun") + F.col("inside"))
    ends = F.col("depth") + F.col("more") == 0
    known = known.withColumns({
        "border": ends,
        "number": F.col("start") + F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)),
        "odd": ~F.col("depth").between(0, 1) | ~(F.col("depth") + F.col("more")).between(0, 1),
        "piece": _uncommented(F.col("piece"), F.col("depth") > 0),
    })
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "piece")))
    joined = known.filter("border OR odd OR piece <> ''").groupBy("file", "number").agg(parts.alias("parts"), F.max("odd").alias("odd"))
    whole = F.array_join(F.transform("parts", lambda part: part["piece"]), "")
    return plain.unionByName(joined.select("file", F.lit(0).cast("bigint").alias("block"), F.col("number").alias("at"), whole.alias("piece"), "odd"))


def _uncommented(piece: Column, inside: Column) -> Column:
    """A piece without its comments, of which one may have begun before it and one may go on behind it."""
    outside = F.when(inside, F.when(F.contains(piece, F.lit("-->")), F.regexp_replace(piece, r"(?s)\A.*?-->", "")).otherwise("")).otherwise(piece)
    return F.regexp_replace(F.regexp_replace(outside, r"(?s)<!--.*?-->", ""), r"(?s)<!--.*\z", "")


def _parsed(pieces: DataFrame) -> DataFrame:
    """One row for each named entry, or for a piece without any: what the piece is, and ``k`` and ``entry``."""
    begins, ends = looks_like_xml(F.col("piece")), F.contains("piece", F.lit("</urlset"))
    body = F.concat(F.when(begins, "").otherwise("<urlset>"), "piece", F.when(ends, "").otherwise(f"{_END}</urlset>"))
    told = pieces.select(
        "file", "block", "at", "odd", begins.alias("begins"), ends.alias("ends"),
        F.when(begins, sitemap_kind(F.col("piece"))).alias("kind"),
        (~begins & F.contains("piece", F.lit("<urlset"))).alias("second"),
        parse_document(body).alias("doc"),
    )
    sound = F.col("doc._corrupt_record").isNull() & ~F.col("odd") & ~F.col("second")
    named = F.filter("doc.url", lambda entry: F.coalesce(entry["loc"], F.lit("")) != "")
    return told.select("file", "block", "at", "begins", "ends", "kind", sound.alias("sound"), F.posexplode_outer(named).alias("k", "entry"))


def _whole(pieces: DataFrame, files: DataFrame, length: int) -> DataFrame:
    """``file, body`` of the given files, but for those of more than ``length`` characters."""
    wanted = pieces.join(files, "file", "left_semi")
    short = wanted.groupBy("file").agg(F.sum(F.length("piece") + len(_END)).alias("length")).filter(F.col("length") <= length)
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "piece")))
    gathered = wanted.join(short, "file", "left_semi").groupBy("file").agg(parts.alias("parts"))
    return gathered.select("file", F.array_join(F.transform("parts", lambda part: part["piece"]), _END).alias("body"))

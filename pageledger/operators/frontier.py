"""Crawling a snapshot: breadth-first reachability with visit order, depth and page limits.

The queue of a crawler is first-in first-out, so its order is (depth, place of the parent, place of the link).
Each level is therefore one join with the edge table.  Levels are written to the checkpoint folder, numbered in
range partitions, and never gathered per site.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageledger import fixed_values as fixed
from pageledger.operators.link_store import LinkStore
from pageledger.operators.numbering import block_starts, in_blocks
from pageledger.operators.sitemap import first_listing
from pageledger.session import cut

def seeds(listing: DataFrame | None, bases: DataFrame, sitemap_only: bool = False) -> DataFrame:
    """Start URLs ``(site, url, ord)``: listed URLs in order, then each site's base URL ``bases (site, url)``."""
    base = bases.select("site", "url", F.lit((1 << 62)).alias("ord"))
    if listing is None:
        return base
    listed = first_listing(listing).select("site", "url", F.col("pos").cast("bigint").alias("ord"))
    if sitemap_only:
        return listed
    return listed.unionByName(base).groupBy("site", "url").agg(F.min("ord").alias("ord"))


def minus(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose ``(site, url)`` is not known yet."""
    return candidates.join(known.select("site", "url"), ["site", "url"], "left_anti")


def first_visit(candidates: DataFrame) -> DataFrame:
    """First queue position per URL, from 0 for ``pos``.

    Parent and link place make one number, so the minimum is a hash aggregate and copies of a hot URL are combined before the shuffle.
    Each has as many digits as a long can have, so no place runs into its parent's.
    """
    digits = F.lit("10000000000000000000").cast("decimal(20,0)")
    place = (F.col("parent_seq").cast("decimal(19,0)") * digits).cast("decimal(38,0)") + F.col("pos").cast("decimal(19,0)")
    first = candidates.groupBy("site", "url").agg(F.min(place.cast("decimal(38,0)")).alias("_first"))
    parent = F.expr("_first div 10000000000000000000BD")
    return first.select("site", "url", parent.cast("bigint").alias("parent_seq"), F.pmod("_first", digits).cast("bigint").alias("pos"))


def _level(fresh: DataFrame, depth: int, before: DataFrame | None, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """One level, written and numbered, and the visits per site ``(site, _visited)`` up to it.

    The visits before it enter through the block starts, one row per site and block, so no level is joined on its site.  ``_visited`` in
    the level's rows tells sites that are full.
    """
    blocks = in_blocks(fresh.withColumn("depth", F.lit(depth)), ["site"], ["parent_seq", "pos", "url"])
    blocks = cut(blocks.select("site", "url", "depth", "block", "local"), "crawl-level")
    starts = block_starts(blocks, ["site"])
    if before is None:
        starts = starts.withColumn("_visited", F.col("_total"))
    else:
        starts = starts.join(before.withColumnRenamed("_visited", "_before"), "site", "left").withColumn("_before", F.coalesce("_before", F.lit(0)))
        starts = starts.withColumns({"_start": F.col("_start") + F.col("_before"), "_visited": F.col("_total") + F.col("_before")})
    rows = blocks.join(starts.select("site", "block", "_start", "_visited"), ["site", "block"])
    rows = rows.select("site", "url", "depth", (F.col("_start") + F.col("local")).alias("seq"), "_visited")
    counts = starts.select("site", "_visited").distinct()
    if before is not None:
        counts = counts.unionByName(before).groupBy("site").agg(F.max("_visited").alias("_visited"))
    return rows if limit is None else rows.filter(F.col("seq") <= limit), cut(counts, "crawl-counts")


def crawl(
    start: DataFrame,
    edges: DataFrame,
    depth: int = fixed.DEFAULT_DEPTH,
    limit: int | None = fixed.DEFAULT_LIMIT,
    follow_links: bool = True,
    state: DataFrame | None = None,
) -> DataFrame:
    """Visits ``(site, url, depth, seq)`` from ``start (site, url, ord)`` over ``edges (site, src, dst, pos)``, or over pages with their
    links, ``(site, src, links array<struct<pos, url>>)``.

    ``limit`` counts pages per site, those of ``state (site, url)`` included; None means all of them.  Pages of the state are never visited
    again and their links are not followed.  ``seq`` is the visit number within the site.
    """
    known = before = None
    if state is not None:
        known = state.select("site", "url")
        before = cut(known.groupBy("site").agg(F.count(F.lit(1)).alias("_visited")), "crawl-counts")
    # pages meet the parents as one slim row each, links spread afterwards; edges meet them row by row, so no page's links are gathered
    links = None
    if follow_links and depth > 0:
        links = LinkStore(edges if "links" in edges.columns else cut(edges.select("site", "src", "dst", "pos"), "crawl-links"))
    first = start.select("site", "url", F.col("ord").alias("parent_seq"), F.lit(0).alias("pos"))
    first = first_visit(first)
    if known is not None:
        first = minus(first, known)
    rows, before = _level(first, 0, before, limit)
    levels = [rows]
    for level in range(1, depth + 1 if follow_links else 1):
        parents = levels[-1]
        if limit is not None:
            parents = parents.filter(F.col("_visited") < limit)
        parents = parents.select("site", F.col("url").alias("src"), F.col("seq").alias("parent_seq"))
        reached = links.of(parents)
        visited = [taken.select("site", "url") for taken in (levels if known is None else [known, *levels])]
        rows, before = _level(minus(first_visit(reached), reduce(DataFrame.unionByName, visited)), level, before, limit)
        if rows.isEmpty():
            break
        levels.append(rows)
    if links is not None:
        links.close()
    return reduce(DataFrame.unionByName, levels).drop("_visited")


def reach(start: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """``site, url, depth`` of all pages within ``depth`` links of ``start (site, url)``, by one recursive query.

    A second way to the depths of :func:`crawl`, without visit order, page limit or state.  The walk keeps every path, as a recursive query
    cannot drop what it has met before, so the depth bound is what ends it, and Spark refuses a walk of more rows than
    ``spark.sql.cteRecursionRowLimit``.  For more than a few levels, or hubs, :func:`crawl` is the way.
    """
    return start.sparkSession.sql(
        """
        WITH RECURSIVE walk(site, url, depth) AS (
          SELECT DISTINCT site, url, 0 FROM {start}
          UNION ALL
          SELECT e.site, e.dst, w.depth + 1 FROM walk w JOIN {edges} e ON e.site = w.site AND e.src = w.url WHERE w.depth < {bound})
        SELECT site, url, min(depth) AS depth FROM walk GROUP BY site, url
        """,
        start=start.select("site", "url"),
        edges=edges.select("site", "src", "dst"),
        bound=int(depth),
    )

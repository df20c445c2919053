"""Links kept by their source page, so that a crawl's levels move parents only.

The links are written once, dealt into as many files as there are shuffle partitions by site and source, and sorted in them: a bucketed
table.  A level's parents are shuffled to the same buckets and meet the links where they lie.  A page with more than ``HOT_LINKS`` links
is dealt over several buckets by a hash of its links, and its parent row is copied to as many; the table of such pages has at most
one row for ``HOT_LINKS`` links.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageledger.session import checkpoint_dir, cut

#: Links of a page that stay together.
HOT_LINKS = 100_000


class LinkStore:
    """``edges (site, src, dst, pos)``, or pages with their links, ``(site, src, links array<struct<pos, url>>)``.

    Edges are read more than once, so they should come from a written table.
    """

    def __init__(self, edges: DataFrame, hot_links: int = HOT_LINKS):
        self.spark = edges.sparkSession
        self.listed = "links" in edges.columns
        name = f"crawl_links_{uuid.uuid4().hex}"
        self.table = name
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if self.listed:
            rows, self.hot = edges.select("site", "src", "links"), None
        else:
            rows = edges = edges.select("site", "src", "dst", "pos")
            self.hot = self._hot(edges, hot_links)
            if self.hot is not None:
                salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("dst", "pos"), F.col("_salts"))).cast("int")
                rows = edges.join(self.hot, ["site", "src"], "left").withColumn("salt", salt).drop("_salts")
        self.keys = ["site", "src"] if self.hot is None else ["site", "src", "salt"]
        placed = rows.repartition(self.buckets, *self.keys)
        writer = placed.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
        writer.option("path", f"{checkpoint_dir(self.spark)}/{name}").saveAsTable(name)
        self.rows = self.spark.table(name)

    @staticmethod
    def _hot(edges: DataFrame, hot_links: int) -> DataFrame | None:
        """Pages with more links than stay together, and over how many buckets they are dealt."""
        many = F.count(F.lit(1)).alias("n")
        if edges.groupBy(F.xxhash64("site", "src").alias("page")).agg(many).filter(F.col("n") > hot_links).isEmpty():
            return None
        counts = edges.groupBy("site", "src").agg(many).filter(F.col("n") > hot_links)
        return cut(counts.select("site", "src", F.ceil(F.col("n") / hot_links).cast("int").alias("_salts")), "crawl-hot")

    def of(self, parents: DataFrame) -> DataFrame:
        """``site, parent_seq, url, pos`` of the links of ``parents (site, src, parent_seq)``."""
        if self.hot is not None:
            parents = parents.join(self.hot, ["site", "src"], "left")
            salts = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
            parents = parents.select("site", "src", "parent_seq", F.explode(salts).alias("salt"))
        reached = parents.join(self.rows, self.keys)
        if not self.listed:
            return reached.select("site", "parent_seq", F.col("dst").alias("url"), "pos")
        met = reached.select("site", "parent_seq", F.explode_outer("links").alias("link"))
        return met.filter(F.col("link").isNotNull()).select("site", "parent_seq", "link.url", "link.pos")

    def close(self) -> None:
        """Forget the table's name.  Its files stay with the other tables of the folder, as frames may still read them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

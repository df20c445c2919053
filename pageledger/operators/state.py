"""Prior state: what earlier runs have recorded, and runs that add to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageledger.operators.frontier import minus
from pageledger.operators.numbering import number_rows
from pageledger.operators.pages import extract_content, one_snapshot
from pageledger.session import cut


def minus_state(candidates: DataFrame, state: DataFrame | None, force: bool = False) -> DataFrame:
    """Drop URLs recorded earlier; ``force`` takes all of them again."""
    return candidates if state is None or force else minus(candidates, state)


def merge_results(state: DataFrame | None, new: DataFrame) -> DataFrame:
    """Earlier records first, then the new ones, whose ``seq`` already follows on."""
    if state is None:
        return new
    return state.select(*[name for name in new.columns if name in state.columns]).unionByName(new, allowMissingColumns=True)


def _not_recorded(pages: DataFrame, state: DataFrame) -> DataFrame:
    """Pages whose address is not in the state.  Only addresses meet the state; the few that are new pick their pages."""
    fresh = cut(minus(pages.select("site", "url").distinct(), state), "fresh")
    fresh = fresh.select(F.col("site").alias("_site"), F.col("url").alias("_url"))
    same = F.col("site").eqNullSafe(F.col("_site")) & F.col("url").eqNullSafe(F.col("_url"))
    return pages.join(fresh, same, "left_semi")


def audit_increment(pages: DataFrame, state: DataFrame | None, force: bool = False) -> DataFrame:
    """Content records of the pages that are not in the state yet, one per address; with ``force`` of all pages.

    Known pages are left out before any text is read.  ``seq`` follows on from the records of the site, and an address that is recorded again
    keeps its number, so the numbers of a site stay dense.  Without a listing no page is in a sitemap.
    """
    if state is not None and not force:
        pages = _not_recorded(pages, state)
    records = one_snapshot(extract_content(pages))
    if state is None:
        records = number_rows(records, ["site"], ["url"], "seq", "increment")
    else:
        numbers = state.select(F.col("site").alias("_site"), F.col("url").alias("_url"), F.col("seq").alias("_seq") if "seq" in state.columns else F.lit(None).cast("bigint").alias("_seq"))
        same = F.col("site").eqNullSafe(F.col("_site")) & F.col("url").eqNullSafe(F.col("_url"))
        # only an address that is in the state already has a number there
        records = records.join(numbers, same, "left").drop("_site", "_url") if force else records.withColumn("_seq", F.lit(None).cast("bigint"))
        records = number_rows(records.withColumn("_known_one", F.col("_seq").isNotNull()), ["site", "_known_one"], ["url"], "seq", "increment")
        known = numbers.groupBy("_site").agg(F.count(F.lit(1)).alias("_known"))
        records = records.join(known, F.col("site").eqNullSafe(F.col("_site")), "left")
        records = records.withColumn("seq", F.coalesce("_seq", F.col("seq") + F.coalesce("_known", F.lit(0)))).drop("_site", "_known", "_seq", "_known_one")
    return records.withColumns({"in_sitemap": F.lit(False), "crawl_date": F.current_timestamp()})

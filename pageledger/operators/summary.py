"""Site-level counts and percentages in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageledger import fixed_values as fixed

_OG = ("og_title", "og_description", "og_image")
_TWITTER = ("twitter_card", "twitter_title", "twitter_description", "twitter_image")


def _present(*names: str) -> Column:
    present = F.col(names[0]) != ""
    for name in names[1:]:
        present = present | (F.col(name) != "")
    return present


def _conditions() -> dict[str, Column]:
    return {
        "pages_with_title": _present("title"),
        "pages_with_description": _present("description"),
        "pages_with_keywords": _present("keywords"),
        "pages_with_h1": F.col("h1_count") > 0,
        "pages_with_canonical": _present("canonical_url"),
        "pages_with_og_tags": _present(*_OG),
        "pages_with_twitter_tags": _present(*_TWITTER),
        "pages_with_title_issues": F.col("title_score") != fixed.GOOD,
        "pages_with_description_issues": F.col("description_score") != fixed.GOOD,
        "pages_with_h1_issues": F.col("h1_score") != fixed.GOOD,
        "pages_with_errors": F.col("error").isNotNull(),
        "pages_in_sitemap": F.coalesce(F.col("in_sitemap"), F.lit(False)),
        "pages_not_in_sitemap": ~F.coalesce(F.col("in_sitemap"), F.lit(False)),
    }


#: The counts of a summary.
COUNTS = (
    "total_pages", "pages_with_title", "pages_with_description", "pages_with_keywords", "pages_with_h1", "pages_with_canonical",
    "pages_with_og_tags", "pages_with_twitter_tags", "pages_with_title_issues", "pages_with_description_issues", "pages_with_h1_issues",
    "pages_with_errors", "pages_in_sitemap", "pages_not_in_sitemap",
)


def audit_summary(records: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """One row per site.  Counts combine map-side, so one big site costs no more than many small ones."""
    counts = [F.count_if(condition).alias(name) for name, condition in _conditions().items()]
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_pages"), *counts)


# percentage column -> the count it belongs to
PERCENTAGES = {percentage: count for _, count, percentage in fixed.SUMMARY_ROWS if percentage}


def audit_percentages(summary: DataFrame) -> DataFrame:
    """Add rounded percentages; divide first, then multiply, then round half up.  An empty set has none."""
    total = F.col("total_pages")

    def share(count: str) -> Column:
        return F.floor(F.try_divide(F.col(count), total) * 100 + 0.5).cast("int")

    return summary.withColumns({name: share(count) for name, count in PERCENTAGES.items()})

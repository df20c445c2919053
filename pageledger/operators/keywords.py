"""Keyword metrics: cleaning, ranking and the keyword list of a prompt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageledger import fixed_values as fixed
from pageledger.functions.text import js_number, js_number_text, js_trim

_INPUT_ORDER = ("file", "sheet_pos", "row_pos")


def detect_columns(headers: Sequence[str]) -> tuple[str | None, str | None, str | None]:
    """Keyword, click and impression headers: the first that contains one of the known names."""

    def first(candidates: Sequence[str]) -> str | None:
        return next((header for header in headers if any(name in header.lower() for name in candidates)), None)

    return first(fixed.KEYWORD_HEADERS), first(fixed.CLICK_HEADERS), first(fixed.IMPRESSION_HEADERS)


def clean_keywords(rows: DataFrame) -> DataFrame:
    """Trim keywords and drop empty ones."""
    return rows.withColumn("keyword", js_trim(F.col("keyword").cast("string"))).filter(F.col("keyword") != "")


def metric(column: str | None) -> Column:
    """A metric column as a number; NULL throughout when the file has no such column."""
    return F.lit(None).cast("double") if column is None else js_number(F.col(column).cast("string"))


def _falling(name: str) -> Column:
    return -F.coalesce(F.col(name), F.lit(0.0))


def top_keywords(metrics: DataFrame, n: int = fixed.TOP_KEYWORDS) -> DataFrame:
    """The ``n`` best keywords ``(rank, keyword, clicks, impressions)``, one per spelling regardless of case.

    The best row of a spelling is a minimum, so copies of a hot keyword are combined map-side.  Ties keep the
    order of the input.
    """
    order = F.struct(_falling("clicks").alias("c"), _falling("impressions").alias("i"), *_INPUT_ORDER)
    best = metrics.groupBy(F.lower("keyword").alias("_spelling")).agg(
        F.min(order).alias("_order"), F.min_by(F.struct("keyword", "clicks", "impressions"), order).alias("_row")
    )
    top = best.orderBy("_order").limit(n)
    # n rows at most from here on
    return top.select(F.row_number().over(W.orderBy("_order")).alias("rank"), "_row.*")


def _top_by(ranked: DataFrame, name: str, k: int) -> DataFrame:
    known = ranked.filter(F.col(name).isNotNull()).orderBy(F.col(name).desc(), "rank").limit(k)
    return known.withColumn("place", F.row_number().over(W.orderBy(F.col(name).desc(), "rank")))


def top_by_impressions(ranked: DataFrame, k: int = fixed.TOP_BY_METRIC) -> DataFrame:
    """The ``k`` keywords with most impressions; unknown impressions do not take part, ties keep ``rank`` order."""
    return _top_by(ranked, "impressions", k)


def top_by_clicks(ranked: DataFrame, k: int = fixed.TOP_BY_METRIC) -> DataFrame:
    return _top_by(ranked, "clicks", k)


def union_first_wins(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first`` then ``second``; of equal keywords the earlier stays."""
    both = first.withColumn("part", F.lit(0)).unionByName(second.withColumn("part", F.lit(1)))
    order = F.struct("part", "place")
    kept = both.groupBy("keyword").agg(
        F.min(order).alias("_order"), F.min_by(F.struct("clicks", "impressions"), order).alias("_row")
    )
    return kept.select(F.col("_order.part").alias("part"), F.col("_order.place").alias("place"), "keyword", "_row.*")


def keyword_label(keyword: Column, clicks: Column, impressions: Column) -> Column:
    """Keyword with its non-zero numbers; the closing bracket follows either of them, the opening only clicks."""
    has_clicks = F.coalesce(clicks, F.lit(0.0)) != 0
    has_impressions = F.coalesce(impressions, F.lit(0.0)) != 0
    return F.concat(
        keyword,
        F.when(has_clicks, F.concat(F.lit(" (clicks: "), js_number_text(clicks))).otherwise(""),
        F.when(has_impressions, F.concat(F.lit(", impressions: "), js_number_text(impressions))).otherwise(""),
        F.when(has_clicks | has_impressions, ")").otherwise(""),
    )


def keyword_list(ranked: DataFrame, k: int = fixed.TOP_BY_METRIC) -> DataFrame:
    """One row ``keyword_list``: the labels of both tops in order; at most ``2 k`` keywords come together."""
    chosen = union_first_wins(top_by_impressions(ranked, k), top_by_clicks(ranked, k))
    label = keyword_label(F.col("keyword"), F.col("clicks"), F.col("impressions"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "place", label.alias("label"))))
    return chosen.agg(F.array_join(F.transform(ordered, lambda entry: entry["label"]), ", ").alias("keyword_list"))

"""The fixed quality rules, as Column predicates and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageledger import fixed_values as fixed


def _label(good: Column) -> Column:
    return F.when(good, fixed.GOOD).otherwise(fixed.NEEDS_IMPROVEMENT)


def _inside(value: Column, bounds: tuple[int, int]) -> Column:
    low, high = bounds
    return (value > low) & (value < high)


def title_score(length: Column) -> Column:
    return _label(_inside(length, fixed.TITLE_BOUNDS))


def description_score(length: Column) -> Column:
    return _label(_inside(length, fixed.DESCRIPTION_BOUNDS))


def keywords_score(count: Column) -> Column:
    return _label(_inside(count, fixed.KEYWORD_BOUNDS))


def h1_score(count: Column) -> Column:
    return _label(count == fixed.SINGLE_H1)


def needs_suggestion() -> Column:
    """True when title, description or keywords score badly; headings do not count."""
    return (
        (F.col("title_score") != fixed.GOOD)
        | (F.col("description_score") != fixed.GOOD)
        | (F.col("keywords_score") != fixed.GOOD)
    )


def suggestion_complete() -> Column:
    """True when all three suggestions are present and not empty."""
    present = [
        F.coalesce(F.col(name) != "", F.lit(False))
        for name in ("suggested_title", "suggested_description", "suggested_keywords")
    ]
    return present[0] & present[1] & present[2]

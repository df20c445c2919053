"""Suggestion requests for pages that score badly, and the reading of model answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageledger import fixed_values as fixed
from pageledger.functions import html, scores, text
from pageledger.functions.sqltext import apply, bind, fold, quote
from pageledger.session import filter_in_place


def select_requests(records: DataFrame) -> DataFrame:
    """Readable pages whose title, description or keywords need work."""
    return filter_in_place(records, F.col("error").isNull() & scores.needs_suggestion())


def _optional(head: str, value: Column, tail: str = "") -> Column:
    """A prompt part that is left out when its value is missing or empty."""
    present = F.coalesce(value != "", F.lit(False))
    return F.when(present, F.concat(F.lit(head), value, F.lit(tail))).otherwise("")


def prompt(
    records: DataFrame,
    keyword_list: DataFrame | None = None,
    excluded: Sequence[str] = (),
) -> DataFrame:
    """Add ``prompt`` to records that carry ``html``.

    ``keyword_list`` is the single row of :func:`pageledger.operators.keywords.keyword_list`.  It enters as a
    scalar subquery: computed once, no join with the pages.
    """
    keywords = F.lit("") if keyword_list is None else keyword_list.select("keyword_list").scalar()
    exclude = "" if not excluded else fixed.PROMPT_EXCLUDE[0] + ", ".join(excluded) + fixed.PROMPT_EXCLUDE[1]
    body = text.js_prefix(html.visible_text(F.col("html")), fixed.PROMPT_TEXT_UNITS)
    whole = F.concat(
        F.lit(fixed.PROMPT_HEAD),
        F.col("url"),
        F.lit(fixed.PROMPT_TASK + exclude),
        _optional(fixed.PROMPT_KEYWORDS, keywords),
        _optional(fixed.PROMPT_TITLE, F.col("title"), '"'),
        _optional(fixed.PROMPT_DESCRIPTION, F.col("description"), '"'),
        _optional(fixed.PROMPT_CURRENT_KEYWORDS, F.col("keywords"), '"'),
        F.lit(fixed.PROMPT_TEXT),
        body,
        F.lit(fixed.PROMPT_TAIL),
    )
    return records.withColumn("prompt", whole)


def request_records(prompts: DataFrame, model: str = fixed.REQUEST_MODEL) -> DataFrame:
    """Rows ``(url, request)`` for a batch of model calls."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    request = F.struct(
        F.lit(model).alias("model"),
        F.array(message("system", F.lit(fixed.REQUEST_SYSTEM)), message("user", F.col("prompt"))).alias("messages"),
        F.struct(F.lit(fixed.REQUEST_FORMAT).alias("type")).alias("response_format"),
        F.lit(fixed.REQUEST_MAX_TOKENS).alias("max_tokens"),
        F.lit(fixed.REQUEST_TEMPERATURE).alias("temperature"),
    )
    return prompts.select("url", F.to_json(request).alias("request"))


_ANSWER = "STRUCT<suggested_title:STRING,suggested_description:STRING,suggested_keywords:STRING>"


def _answer_sql() -> str:
    """SQL over ``r.content``: the three suggestions, read as JSON or, failing that, by pattern."""
    title, description, keywords = fixed.RESPONSE_KEYS

    def typed(key: str) -> str:
        return f"schema_of_variant(try_variant_get(doc, '$.{key}', 'variant'))"

    def value(key: str) -> str:
        return f"try_variant_get(doc, '$.{key}', 'string')"

    def by_pattern(key: str) -> str:
        return f"nullif(regexp_extract(r.content, {quote(f'"{key}"\\s*:\\s*"([^"]+)"')}, 1), '')"

    # an answer whose keywords are neither text nor empty cannot be lower-cased, so all of it is read by pattern
    empty_value = f"lower({value(keywords)}) IN ('', '0', '0.0', 'false')"
    readable = (
        f"schema_of_variant(doc) <> 'VOID' AND (coalesce({typed(keywords)} IN ('VOID', 'STRING'), true)"
        f" OR (coalesce({empty_value}, false)))"
    )
    falsy = f"coalesce({typed(keywords)} <> 'STRING' OR {value(keywords)} = '', true)"

    def answer(title_sql: str, description_sql: str, keywords_sql: str) -> str:
        return (
            f"named_struct('suggested_title', {title_sql}, 'suggested_description', {description_sql},"
            f" 'suggested_keywords', {keywords_sql})"
        )

    parsed = answer(value(title), value(description), f"CASE WHEN {falsy} THEN NULL ELSE lower({value(keywords)}) END")
    guessed = answer(by_pattern(title), by_pattern(description), f"lower({by_pattern(keywords)})")
    read = fold({f"doc IS NOT NULL AND {readable}": parsed}, guessed)
    return bind("try_parse_json(r.content)", "doc", read, _ANSWER)


def parse_response(content: Column) -> Column:
    """``struct<suggested_title,suggested_description,suggested_keywords>``; all NULL without an answer."""
    return apply("r", _answer_sql(), _ANSWER, content=content)


def attach_suggestions(records: DataFrame, responses: DataFrame) -> DataFrame:
    """Add the suggestions of ``responses (url, content)``; pages without an answer get NULLs."""
    first = responses.groupBy("url").agg(F.min("content").alias("content"))
    parsed = first.select("url", parse_response(F.col("content")).alias("_answer")).select("url", "_answer.*")
    names = [name for name in parsed.columns if name != "url"]
    return records.drop(*names).join(parsed, "url", "left")

"""Report rows: CSV view and lines, HTML page rows, HTML summary rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageledger import fixed_values as fixed
from pageledger.functions.text import escape_html, js_number_text


def csv_view(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The eight report columns, missing values as empty text."""
    return records.select(
        *keep, *[F.coalesce(F.col(column), F.lit("")).alias(name) for name, column in fixed.CSV_COLUMNS]
    )


def _csv_field(name: str, kind: T.DataType) -> Column:
    value = F.col(name)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        written = F.concat(F.lit('"'), F.replace(F.to_json(value), F.lit('"'), F.lit('""')), F.lit('"'))
    elif isinstance(kind, T.StringType):
        quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
        written = F.when(value.rlike(r'[",\r\n]'), quoted).otherwise(value)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        written = js_number_text(value)
    else:
        written = value.cast("string")
    return F.coalesce(written, F.lit(""))


def csv_line(view: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row as one CSV line, next to the columns in ``keep``, which are not part of the line."""
    fields = [_csv_field(field.name, field.dataType) for field in view.schema if field.name not in keep]
    return view.select(*keep, F.concat_ws(",", *fields).alias("line"))


def csv_header(view: DataFrame, keep: tuple[str, ...] = ()) -> str:
    return ",".join(name for name in view.columns if name not in keep)


def csv_lines(view: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Header first when there is any row, then the lines; ``is_header`` tells them apart."""
    lines = csv_line(view, keep).withColumn("is_header", F.lit(False))
    blank = [F.lit(None).cast(view.schema[name].dataType).alias(name) for name in keep]
    header = view.limit(1).select(*blank, F.lit(csv_header(view, keep)).alias("line"), F.lit(True).alias("is_header"))
    return header.unionByName(lines)


def _cell(template: str, value: Column, style: Column | None = None) -> Column:
    """Fill a cell format: ``{0}`` is the value, ``{1}`` the style."""
    pieces: list[Column] = []
    for index, part in enumerate(template.replace("{1}", "{0}\0").split("{0}")):
        if index:
            pieces.append(style if part.startswith("\0") else value)
        pieces.append(F.lit(part.removeprefix("\0")))
    return F.concat(*pieces)


def _score_cell(name: str) -> Column:
    good, bad = fixed.HTML_SCORE_CLASSES
    style = F.when(F.col(name) == fixed.GOOD, good).otherwise(bad)
    return _cell(fixed.HTML_CELL_SCORE, escape_html(F.col(name)), style)


def html_rows(records: DataFrame) -> DataFrame:
    """One ``<tr>`` per page, numbered by ``seq``; a record without a number keeps its row."""

    def text(name: str) -> Column:
        return escape_html(F.coalesce(F.col(name), F.lit("")))

    yes, no = fixed.HTML_SITEMAP_TEXT
    inside, outside = fixed.HTML_SITEMAP_CLASSES
    listed = F.col("in_sitemap")
    cells = [
        _cell(fixed.HTML_CELL_NOWRAP, F.coalesce(F.col("seq").cast("string"), F.lit(""))),
        _cell(fixed.HTML_CELL_LINK, text("url")),
        _cell(fixed.HTML_CELL_PLAIN, text("title")),
        _cell(fixed.HTML_CELL_PLAIN, text("suggested_title")),
        _score_cell("title_score"),
        _cell(fixed.HTML_CELL_PLAIN, text("description")),
        _cell(fixed.HTML_CELL_PLAIN, text("suggested_description")),
        _score_cell("description_score"),
        _cell(fixed.HTML_CELL_PLAIN, text("h1_text")),
        _score_cell("h1_score"),
        _cell(fixed.HTML_CELL_NOWRAP, text("canonical_url")),
        _cell(fixed.HTML_CELL_SITEMAP, F.when(listed, yes).otherwise(no), F.when(listed, inside).otherwise(outside)),
        _cell(fixed.HTML_CELL_ERROR, text("error")),
    ]
    row = F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))
    return records.select("site", "seq", row.alias("row_html"))


def html_summary(summary: DataFrame) -> DataFrame:
    """The metric rows of each site: position, label, count, percentage and the table row."""
    entries = F.array(
        *[
            F.struct(
                F.lit(place).alias("position"),
                F.lit(label).alias("metric"),
                F.col(count).cast("bigint").alias("count"),
                (F.lit(100) if share is None else F.col(share)).cast("int").alias("percentage"),
            )
            for place, (label, count, share) in enumerate(fixed.SUMMARY_ROWS, start=1)
        ]
    )
    rows = summary.select("site", F.inline(entries))
    label_open, rest = fixed.SUMMARY_ROW_FORMAT.split("{label}")
    count_open, rest = rest.split("{count}")
    share_open, share_close = rest.split("{percentage}")
    row = F.concat(
        F.lit(label_open),
        escape_html(F.col("metric")),
        F.lit(count_open),
        F.col("count").cast("string"),
        F.lit(share_open),
        F.coalesce(F.col("percentage").cast("string"), F.lit("")),
        F.lit(share_close),
    )
    return rows.withColumn("row_html", row)

"""Writers for reports, state and change sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageledger.operators.report import csv_lines, csv_view, html_rows, html_summary
from pageledger.operators.state_log import append
from pageledger.session import cut

def write_json(records: DataFrame, path: str, base_url: str, options: dict[str, str]) -> None:
    """Records one per line under ``pages``, the run header as one row under ``run``."""
    records.write.mode("overwrite").json(f"{path}/pages")
    settings = F.create_map(*[F.lit(str(part)) for pair in options.items() for part in pair]) if options else F.lit(None)
    header = records.sparkSession.range(1).select(
        F.current_timestamp().alias("crawl_date"), F.lit(base_url).alias("base_url"), settings.alias("options")
    )
    header.coalesce(1).write.mode("overwrite").json(f"{path}/run")


def write_csv(records: DataFrame, path: str) -> None:
    """The CSV report in visit order, header line first; no records, no lines."""
    lines = cut(csv_lines(csv_view(records, keep=("site", "seq")), keep=("site", "seq")), "csv-lines")
    ordered = lines.orderBy(F.col("is_header").desc(), "site", "seq")
    ordered.select("line").write.mode("overwrite").text(path)


def write_html(records: DataFrame, summary: DataFrame, path: str) -> None:
    """Table rows of the HTML report, for pages and for the summary with percentages."""
    cut(html_rows(records), "html-rows").orderBy("site", "seq").select("row_html").write.mode("overwrite").text(f"{path}/pages")
    rows = html_summary(summary).orderBy("site", "position").select("row_html")
    rows.write.mode("overwrite").text(f"{path}/summary")


def write_state(records: DataFrame, path: str, replaces: bool = False) -> None:
    """Add a run's records to the state.  ``replaces`` is for a forced run over whole sites: what earlier runs recorded of them ends."""
    append(records, path, replaces)


def write_changes(changes: DataFrame, path: str, sink_format: str = "parquet") -> None:
    changes.write.mode("overwrite").format(sink_format).save(path)

from pyspark.sql import functions as F

from pageledger.operators import report
from pageledger.operators.pages import error_defaults
from pageledger.operators.summary import audit_percentages, audit_summary
from pageledger.schemas import PAGE_METADATA
from pageledger.sinks import tables as sinks


def records(spark, total, **columns):
    """``total`` empty records of one site with some columns set by expression over ``id``."""
    frame = spark.range(total).withColumns(error_defaults())
    extra = {"site": F.lit("s"), "seq": F.col("id") + 1, "url": F.concat(F.lit("u"), F.col("id").cast("string")), "in_sitemap": F.lit(False)}
    frame = frame.withColumns({**extra, **{name: F.expr(text) for name, text in columns.items()}})
    return frame.select(*[
        (F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in PAGE_METADATA
    ])


def test_percentages_divide_first_and_round_half_up(spark):
    frame = records(spark, 40, title="IF(id < 23, 't', '')", in_sitemap="id < 5", og_image="IF(id = 0, 'x', '')", error="IF(id = 1, 'e', NULL)")
    row = audit_percentages(audit_summary(frame)).head()
    assert (row.total_pages, row.pages_with_title, row.title_completeness) == (40, 23, 57)
    assert (row.pages_in_sitemap, row.in_sitemap_percentage, row.pages_not_in_sitemap, row.not_in_sitemap_percentage) == (5, 13, 35, 88)
    assert (row.pages_with_og_tags, row.og_tags_percentage, row.pages_with_errors) == (1, 3, 1)
    assert row.pages_with_title_issues == 40
    empty = audit_percentages(audit_summary(frame.limit(0), keys=())).head()
    assert (empty.total_pages, empty.title_completeness) == (0, None)


def test_csv_fields(spark):
    frame = spark.createDataFrame(
        [("a,b", 'say "x"', "two\nlines", None, 1.0, True, ["x", '"'])],
        "a string, b string, c string, d string, e double, f boolean, g array<string>",
    )
    lines = [row.line for row in report.csv_lines(frame).orderBy(F.col("is_header").desc()).collect()]
    assert lines == ["a,b,c,d,e,f,g", '"a,b","say ""x""","two\nlines",,1,true,"[""x"",""\\""""]"']
    assert report.csv_lines(frame.limit(0)).count() == 0


def test_html_row(spark):
    frame = records(spark, 1, title="""'<"&\\'>'""", title_score="'good'", in_sitemap="true", error="'E & F'")
    row = report.html_rows(frame).head().row_html
    assert row.startswith('<tr><td class="nowrap">1</td><td class="nowrap"><a href="u0" target="_blank">u0</a></td><td>&lt;&quot;&amp;&#39;&gt;</td><td></td>')
    assert '<span class="score-good">good</span>' in row and '<span class="score-bad">needs improvement</span>' in row
    assert row.endswith('<td class="nowrap"><span class="in-sitemap">Yes</span></td><td class="nowrap error">E &amp; F</td></tr>')


def test_summary_rows(spark):
    rows = report.html_summary(audit_percentages(audit_summary(records(spark, 4, title="'t'")))).orderBy("position").collect()
    assert len(rows) == 14
    assert rows[0].row_html == "<tr><td>Total Pages</td><td>4</td><td>100%</td></tr>"
    assert rows[1].row_html == "<tr><td>Pages with Title</td><td>4</td><td>100%</td></tr>"


def test_sinks(spark, tmp_path):
    frame = records(spark, 30, title="concat('t,', id)")
    sinks.write_csv(frame, str(tmp_path / "csv"))
    lines = [line for part in sorted((tmp_path / "csv").glob("part-*")) for line in part.read_text().splitlines()]
    assert lines[0].startswith("url,title,suggestedTitle") and len(lines) == 31
    assert [line.split(",")[0] for line in lines[1:]] == [f"u{at}" for at in range(30)]
    sinks.write_html(frame, audit_percentages(audit_summary(frame)), str(tmp_path / "html"))
    assert spark.read.text(str(tmp_path / "html/pages")).count() == 30
    sinks.write_json(frame, str(tmp_path / "json"), "https://x.org", {"depth": "3"})
    assert spark.read.json(str(tmp_path / "json/run")).head().base_url == "https://x.org"
    assert spark.read.json(str(tmp_path / "json/pages")).count() == 30

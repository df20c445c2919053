"""Physical plans: no joins of all pairs, no page text in a shuffle, pruned scans, one parse per page."""

import re

import pytest

import __spark_entry__ as entry
from pageledger.operators.pages import extract_content, link_edges
from pageledger.operators.suggest import select_requests
from pageledger.plans import inputs

FOLDER = "/root/testdata/sf0.001"
TOKEN_SCAN = "(?:a|h1|link|meta)"


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["graph_bfs", "sitemap_attrs", "audit_summary", "keyword_list", "suggest_requests", "tags_to_create", "incremental_audit"])
def test_no_pairwise_joins(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan_of(entry.queries()[name](spark, FOLDER)))


def test_extraction_is_map_only_and_parses_once(spark):
    pages = inputs.site_pages(spark, FOLDER)
    for frame in (extract_content(pages), link_edges(extract_content(pages)), select_requests(extract_content(pages))):
        plan = plan_of(frame)
        assert "Exchange" not in plan
        assert plan.count(TOKEN_SCAN) == 1


def test_page_text_stays_out_of_shuffles(spark):
    plan = plan_of(entry.queries()["incremental_audit"](spark, FOLDER))
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "html" not in line


def test_scans_read_only_what_is_asked_for(spark):
    plan = plan_of(entry.queries()["url_parts"](spark, FOLDER))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan


def test_a_crawl_level_is_numbered_in_one_shuffle(spark):
    from pageledger.operators.numbering import in_blocks

    frame = spark.range(100).selectExpr("'s' AS site", "id AS parent_seq", "0 AS pos", "string(id) AS url")
    plan = plan_of(in_blocks(frame, ["site"], ["parent_seq", "pos", "url"]))
    assert plan.count("Exchange") == 1 and "Window" not in plan


def test_first_visits_are_hash_aggregates(spark):
    from pageledger.operators.frontier import first_visit

    frame = spark.range(100).selectExpr("'s' AS site", "string(id) AS url", "id AS parent_seq", "0 AS pos")
    plan = plan_of(first_visit(frame))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_a_level_moves_no_links(spark):
    """Parents are shuffled to the buckets of the links, which stay where they are; also when a hot page is dealt over several."""
    from pageledger.operators.link_store import LinkStore

    rows = [("s", f"p{0 if i < 300 else i % 7}", f"q{i}", i) for i in range(400)]
    edges = spark.createDataFrame(rows, "site string, src string, dst string, pos bigint")
    parents = spark.createDataFrame([("s", f"p{i}", i + 1) for i in range(5)], "site string, src string, parent_seq bigint")
    expected = sorted((r.dst, r.pos, int(r.src[1:]) + 1) for r in edges.collect() if int(r.src[1:]) < 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for hot, salted in ((1000, False), (50, True)):
            store = LinkStore(edges, hot)
            reached = store.of(parents)
            plan = plan_of(reached)
            links = plan[plan.rindex("SortMergeJoin" if not salted else "Generate") :]
            scan = next(line for line in plan.splitlines() if "FileScan" in line and store.table in line)
            assert "Bucketed: true" in scan and f"out of {store.buckets}" in plan
            after = plan[: plan.index(scan)].splitlines()[-2:]
            assert not any("Exchange" in line for line in after), links
            assert (store.hot is not None) == salted
            if salted:
                assert store.rows.select("src", "salt").distinct().filter("src = 'p0'").count() == 7
            assert sorted((r.url, r.pos, r.parent_seq) for r in reached.collect()) == expected
            store.close()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_visits_tell_any_places_apart(spark):
    from pageledger.operators.frontier import first_visit

    largest = (1 << 63) - 1
    rows = [("s", "a", 5, largest), ("s", "a", 6, 0), ("s", "b", largest, 7), ("s", "b", largest, 3), ("s", "c", 0, largest), ("s", "c", 1, 0)]
    frame = spark.createDataFrame(rows, "site string, url string, parent_seq bigint, pos bigint")
    found = {r.url: (r.parent_seq, r.pos) for r in first_visit(frame).collect()}
    assert found == {"a": (5, largest), "b": (largest, 3), "c": (0, largest)}

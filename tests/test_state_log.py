"""The state as a log of segments: versions, replaced sites, rewriting."""

from pyspark.sql import functions as F

from pageledger.operators import state, state_log
from pageledger.sinks.tables import write_state
from pageledger.sources.tables import read_state

PAGES = "site string, url string, status int, html string"


def pages(spark, title, *urls):
    rows = [(url.split("/")[0], url, 200, f"<title>{title}</title>") for url in urls]
    return spark.createDataFrame(rows, PAGES)


def run(spark, path, *batches, force=False):
    for batch in batches:
        write_state(state.audit_increment(batch, read_state(spark, path), force), path)


def records(spark, path):
    return sorted((r.url, r.title, r.seq) for r in read_state(spark, path).collect())


def test_a_forced_run_records_each_address_once(spark, tmp_path):
    path = str(tmp_path / "state")
    run(spark, path, pages(spark, "a", "x/2", "x/1", "y/1"))
    run(spark, path, pages(spark, "b", "x/2", "x/3"), force=True)
    assert records(spark, path) == [("x/1", "a", 1), ("x/2", "b", 2), ("x/3", "b", 3), ("y/1", "a", 1)]
    run(spark, path, pages(spark, "c", "x/0", "x/2"))
    assert records(spark, path) == [("x/0", "c", 4), ("x/1", "a", 1), ("x/2", "b", 2), ("x/3", "b", 3), ("y/1", "a", 1)]


def test_a_replacing_run_ends_what_was_there(spark, tmp_path):
    path = str(tmp_path / "state")
    run(spark, path, pages(spark, "a", "x/1", "x/2", "y/1"))
    write_state(state.audit_increment(pages(spark, "b", "x/9"), None), path, replaces=True)
    assert records(spark, path) == [("x/9", "b", 1), ("y/1", "a", 1)]
    run(spark, path, pages(spark, "c", "x/1"))
    expected = [("x/1", "c", 2), ("x/9", "b", 1), ("y/1", "a", 1)]
    assert records(spark, path) == expected
    state_log.compact(spark, path, many=2)
    assert records(spark, path) == expected


def test_only_full_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "state")
    run(spark, path, pages(spark, "a", "x/1", "y/1"), pages(spark, "b", "x/2"), pages(spark, "c", "x/1", "x/3"))
    before = records(spark, path)
    bucket = {r.site: r.b for r in spark.createDataFrame([("x",), ("y",)], "site string").select("site", state_log.site_bucket(F.col("site")).alias("b")).collect()}
    assert bucket["x"] != bucket["y"]
    assert state_log.compact(spark, path, many=3) == [bucket["x"]]
    held = [(s.number, s.buckets) for s in state_log.segments(spark, path)]
    assert held == [(1, (bucket["y"],)), (2, ()), (3, ()), (4, (bucket["x"],))]
    assert records(spark, path) == before
    assert state_log.compact(spark, path, many=3) == []
    run(spark, path, pages(spark, "d", "x/4"))
    assert [s.number for s in state_log.segments(spark, path)][-1] == 5
    assert records(spark, path) == sorted([*before, ("x/4", "d", 4)])


def test_an_interrupted_rewrite_changes_nothing(spark, tmp_path, monkeypatch):
    """The new segment is whole, but the folders it supersedes are still there."""
    path = str(tmp_path / "state")
    run(spark, path, pages(spark, "a", "x/1"), pages(spark, "b", "x/2"))
    run(spark, path, pages(spark, "c", "x/1"), force=True)
    before = records(spark, path)
    kept = {s.path: s for s in state_log.segments(spark, path)}
    copies = {s: (tmp_path / f"copy{n}") for n, s in enumerate(kept)}
    for folder, copy in copies.items():
        spark.read.parquet(folder).write.partitionBy("site_bucket").parquet(str(copy))
    state_log.compact(spark, path, many=2)
    for folder, copy in copies.items():  # as they were before they were removed
        spark.read.parquet(str(copy)).write.mode("append").partitionBy("site_bucket").parquet(folder)
    assert len(state_log.segments(spark, path)) == 4 and records(spark, path) == before


def test_a_segment_that_is_not_whole_is_not_read(spark, tmp_path):
    path = tmp_path / "state"
    run(spark, str(path), pages(spark, "a", "x/1"), pages(spark, "b", "x/2"))
    (path / "segment=2" / "replaces=false" / "_SUCCESS").unlink()
    assert records(spark, str(path)) == [("x/1", "a", 1)]
    run(spark, str(path), pages(spark, "c", "x/2"))
    assert records(spark, str(path)) == [("x/1", "a", 1), ("x/2", "c", 2)]
    assert [s.number for s in state_log.segments(spark, str(path))] == [1, 3]


def test_reading_one_site_reads_its_bucket(spark, tmp_path):
    path = str(tmp_path / "state")
    run(spark, path, pages(spark, "a", "x/1", "y/1"), pages(spark, "b", "x/2"))
    files = read_state(spark, path, "x").inputFiles()
    assert sorted(r.url for r in read_state(spark, path, "x").collect()) == ["x/1", "x/2"]
    bucket = spark.range(1).select(state_log.site_bucket(F.lit("y"))).head()[0]
    assert files and not any(f"site_bucket={bucket}/" in file for file in files)

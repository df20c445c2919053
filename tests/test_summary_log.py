from pageledger.operators import state, state_log, summary_log
from pageledger.operators.summary import COUNTS, audit_summary
from pageledger.streaming.audit_stream import audit_stream

PAGES = "site string, url string, status int, html string"


def pages(spark, site, numbers, text="<title>A title long enough</title><h1>x</h1>", status=200):
    return spark.createDataFrame([(site, f"https://{site}/{n}", status, text) for n in numbers], PAGES)


def rows(frame):
    return sorted(tuple(row) for row in frame.select("site", *COUNTS).collect())


def same(spark, log, counts):
    kept = rows(summary_log.read(spark, counts))
    assert kept == rows(audit_summary(state_log.read(spark, log)))
    return {row[0]: row[1] for row in kept}


def add(spark, batch, log, force=False, replaces=False):
    known = state_log.read(spark, log)
    return state_log.append(state.audit_increment(batch, known, force=force), log, replaces=replaces)


def test_counts_follow_all_runs(spark, tmp_path):
    log, counts = str(tmp_path / "log"), str(tmp_path / "counts")
    summary_log.update(spark, log, counts)
    assert summary_log.read(spark, counts).collect() == []
    add(spark, pages(spark, "a", range(5)), log)
    add(spark, pages(spark, "b", range(3), status=404), log)
    summary_log.update(spark, log, counts)
    assert same(spark, log, counts) == {"a": 5, "b": 3}
    add(spark, pages(spark, "a", range(2, 8), "<title>t</title>"), log, force=True)
    summary_log.update(spark, log, counts)
    summary_log.update(spark, log, counts)
    assert same(spark, log, counts) == {"a": 8, "b": 3}
    add(spark, pages(spark, "b", range(1)), log, force=True, replaces=True)
    add(spark, pages(spark, "a", range(3)), log)
    summary_log.update(spark, log, counts, many=2)
    assert same(spark, log, counts) == {"a": 8, "b": 1}
    assert len(summary_log._parts(spark, counts)) == 1


def test_runs_rewritten_before_they_were_counted(spark, tmp_path):
    log, counts = str(tmp_path / "log"), str(tmp_path / "counts")
    add(spark, pages(spark, "a", range(4)), log)
    summary_log.update(spark, log, counts)
    assert state_log.compact(spark, log, many=1)
    summary_log.update(spark, log, counts)
    assert len(summary_log._parts(spark, counts)) == 1
    add(spark, pages(spark, "a", range(2, 6), "<title>t</title>"), log, force=True)
    add(spark, pages(spark, "c", range(2)), log)
    state_log.compact(spark, log, many=2)
    summary_log.update(spark, log, counts)
    assert same(spark, log, counts) == {"a": 6, "c": 2}
    add(spark, pages(spark, "c", range(1, 3), "none"), log, force=True)
    summary_log.update(spark, log, counts)
    assert same(spark, log, counts) == {"a": 6, "c": 3}


def test_stream_keeps_the_counts(spark, tmp_path):
    source, log, counts = (str(tmp_path / name) for name in ("in", "log", "counts"))
    for numbers in (range(3), range(2, 5)):
        pages(spark, "x.org", numbers).coalesce(1).write.mode("append").parquet(source)
        audit_stream(spark, source, log, str(tmp_path / "checkpoint"), files=1, summary=counts).awaitTermination()
        same(spark, log, counts)
    assert same(spark, log, counts) == {"x.org": 5}

from pyspark.sql import functions as F

from pageledger.operators import state
from pageledger.session import checkpoint_dir, cut
from pageledger.sinks.tables import write_state
from pageledger.sources.tables import read_state
from pageledger.streaming.audit_stream import audit_stream

PAGES = "site string, url string, status int, html string"


def pages(spark, *numbers):
    rows = [("x.org", f"https://x.org/{n}", 200, f"<title>t{n}</title>") for n in numbers]
    return spark.createDataFrame(rows, PAGES)


def test_second_increment_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "state")
    assert read_state(spark, path).count() == 0
    for batch, total in ((pages(spark, 1, 2), 2), (pages(spark, 1, 2), 2), (pages(spark, 2, 3), 3)):
        write_state(state.audit_increment(batch, read_state(spark, path)), path)
        assert read_state(spark, path, "x.org").count() == total
    assert read_state(spark, path, "y.org").count() == 0
    stored = read_state(spark, path)
    assert stored.filter(F.col("crawl_date").isNull()).count() == 0
    assert state.audit_increment(pages(spark, 1), stored, force=True).count() == 1


def test_stream_equals_batch_and_survives_restart(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))

    def arrive(*numbers):
        pages(spark, *numbers).write.mode("append").parquet(source)
        audit_stream(spark, source, target, checkpoint).awaitTermination()
        return sorted(row.title for row in spark.read.parquet(target).collect())

    assert arrive(1, 2) == ["t1", "t2"]
    assert arrive(1, 2) == ["t1", "t2"]
    assert arrive(2, 3) == ["t1", "t2", "t3"]
    batch = state.audit_increment(pages(spark, 1, 2, 3), None)
    assert sorted(row.title for row in batch.collect()) == ["t1", "t2", "t3"]


def test_lineage_is_cut_in_the_named_folder(spark):
    kept = cut(spark.range(10), "sample")
    folder = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_dir(spark) == folder
    assert kept.count() == 10 and all(folder in file for file in kept.inputFiles())

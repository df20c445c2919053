"""Incremental audit of pages that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from pageledger.operators import state_log, summary_log
from pageledger.operators.pages import with_site
from pageledger.operators.state import audit_increment
from pageledger.schemas import PAGES

#: Files that one batch takes, so that progress is saved between batches of bounded size.
FILES_PER_BATCH = 1_000


def audit_stream(
    spark: SparkSession, source: str, target: str, checkpoint: str, files: int = FILES_PER_BATCH, summary: str | None = None
) -> StreamingQuery:
    """Take all files not yet processed at ``source``, add the records of new addresses to the state at ``target``, and stop.

    Each batch is a batch increment against those buckets of the stored state that its sites are in, so stream and batch runs share one
    state, nothing is held in memory between batches, and a batch that is run again finds its addresses recorded.  Buckets that many
    batches have added to are rewritten, so the number of files to look at stays bounded.  With ``summary`` the counts per
    site are kept there, by the differences that each batch makes.
    """

    def take(batch: DataFrame, _: int) -> None:
        pages = with_site(batch.drop("site"))
        buckets = [row[0] for row in pages.select(state_log.site_bucket(F.col("site"))).distinct().collect()]  # at most as many as there are buckets
        state = state_log.read(batch.sparkSession, target, buckets)
        state_log.append(audit_increment(pages, state), target)
        if summary is not None:
            summary_log.update(batch.sparkSession, target, summary)
        state_log.compact(batch.sparkSession, target)

    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).parquet(source)
    return pages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

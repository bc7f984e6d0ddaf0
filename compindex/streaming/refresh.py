"""Keyed upserts of the observation cache from a folder of landed files.

The batch operator does the work (``compindex.sources.cache.upsert_series``); the stream only
decides which files are new and remembers them in its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from compindex.session import scratch_path
from compindex.sources import cache as U

LANDED_SCHEMA = "key string, name string, year int, value double, series string"


def refresh(spark: SparkSession, landed: str, cache: str, progress: str | None = None) -> StreamingQuery:
    """Apply every file that landed since the last run, then stop.

    A file carries whole series, as a connector delivers them; replaying a batch gives the
    same cache, so a failed run can simply be started again.
    """
    files = spark.readStream.schema(LANDED_SCHEMA).option("maxFilesPerTrigger", 1).parquet(landed)

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            U.upsert_series(spark, cache, batch)

    writer = files.writeStream.foreachBatch(apply).trigger(availableNow=True)
    return writer.option("checkpointLocation", progress or scratch_path(spark, "refresh")).start()

"""Incremental ingest of daily files: each micro-batch becomes one version of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemeter.session import scratch_path
from tidemeter.sources import ingest as batch_ingest
from tidemeter.streaming.flows import read_stream

ROW_SCHEMA = "event_id bigint, ts timestamp, station_field string, card bigint, exits double, date date"


def ingest_stream(
    spark: SparkSession,
    source: str,
    folder: str,
    files_per_trigger: int | None = None,
    process_types: tuple[str, ...] = (batch_ingest.CHECKINS, batch_ingest.CHECKOUTS),
) -> batch_ingest.Store:
    """Process every file below ``source`` once and return the newest store.

    The ledger holds a file by its path, and a batch adds the sums of its new files, so a day may come in several files and
    batches. A batch starts from the newest complete version: one that is run again finds its files in the
    ledger or overwrites what it left. A call without new files returns the store as it is.
    """
    batch_ingest.begin(spark, folder)

    def handle(rows: DataFrame, batch_id: int) -> None:
        session = rows.sparkSession
        keyed = rows.persist()
        if not keyed.isEmpty():
            batch_ingest.advance(session, folder, batch_ingest.newest_version(session, folder), keyed, process_types)
        keyed.unpersist()

    stream = read_stream(spark, source, ROW_SCHEMA, "csv", files_per_trigger).withColumn("file_id", F.col("_metadata.file_path"))
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return batch_ingest.load(spark, folder, batch_ingest.newest_version(spark, folder))


def scratch_store(spark: SparkSession) -> str:
    return scratch_path(spark, "store")


__all__ = ["ingest_stream", "scratch_store"]

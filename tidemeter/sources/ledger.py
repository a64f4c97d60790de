"""Ledger of processed files, keyed by (filename, process_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["filename", "process_type"]
SCHEMA = "filename string, process_type string, processed boolean, processed_at timestamp, created_at timestamp"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def get_or_create(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Add an unprocessed record for every (filename, process_type) the ledger lacks."""
    fresh = files.select(*KEYS).distinct().join(ledger.select(*KEYS), KEYS, "left_anti")
    added = fresh.select(
        *KEYS,
        F.lit(False).alias("processed"),
        F.lit(None).cast("timestamp").alias("processed_at"),
        F.current_timestamp().alias("created_at"),
    )
    return ledger.unionByName(added)


def mark_processed(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Set the flag for the given files, creating missing records."""
    hits = files.select(*KEYS).distinct().withColumn("_hit", F.lit(True))
    merged = ledger.join(hits, KEYS, "full_outer")
    hit = F.col("_hit").isNotNull()
    now = F.current_timestamp()
    return merged.select(
        *KEYS,
        (hit | F.coalesce("processed", F.lit(False))).alias("processed"),
        F.when(hit, now).otherwise(F.col("processed_at")).alias("processed_at"),
        F.coalesce("created_at", now).alias("created_at"),
    )


def unprocessed(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that have no processed record."""
    return files.join(ledger.where("processed").select(*KEYS), KEYS, "left_anti")


def is_processed(ledger: DataFrame, filename: str, process_type: str) -> bool:
    hit = (F.col("filename") == filename) & (F.col("process_type") == process_type) & F.col("processed")
    return not ledger.where(hit).isEmpty()


def by_file(ledger: DataFrame, filename: str) -> DataFrame:
    return ledger.where(F.col("filename") == filename).orderBy("process_type")


def delete(ledger: DataFrame, filename: str, process_type: str | None = None) -> DataFrame:
    gone = F.col("filename") == filename
    if process_type is not None:
        gone = gone & (F.col("process_type") == process_type)
    return ledger.where(~gone)

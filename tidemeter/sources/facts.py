"""Keyed fact tables: partial-column upsert, point access and partitioned storage."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNT_KEYS = ["year", "month", "day", "day_of_week", "time", "date_type", "station_id"]
COUNT_MEASURES = ["count_in", "count_out", "variance_in_1min"]
RATE_MEASURES = ["estimated_lambda_in", "estimated_lambda_out"]


def upsert(
    stored: DataFrame,
    incoming: DataFrame,
    keys: list[str],
    measures: list[str],
    stamp: str | None = None,
) -> DataFrame:
    """Insert unknown keys; on known keys overwrite only the measures that ``incoming`` carries.

    Supplied measures overwrite even with null. Both sides hold one row per key, so the join cannot
    multiply rows.
    """
    supplied = [m for m in measures if m in incoming.columns]
    new = incoming.select(*keys, *[F.col(m).alias(f"_new_{m}") for m in supplied], F.lit(True).alias("_hit"))
    merged = stored.join(new, keys, "full_outer")
    hit = F.col("_hit").isNotNull()
    out = [*keys]
    for column in stored.columns:
        if column in keys:
            continue
        if column in supplied:
            out.append(F.when(hit, F.col(f"_new_{column}")).otherwise(F.col(column)).alias(column))
        elif column == stamp:
            out.append(F.when(hit, F.current_timestamp()).otherwise(F.col(column)).alias(column))
        else:
            out.append(F.col(column))
    return merged.select(*out)


def _matches(filters: dict[str, Any]):
    condition = F.lit(True)
    for name, value in filters.items():
        condition = condition & (F.col(name) == F.lit(value))
    return condition


def get(facts: DataFrame, **filters: Any) -> DataFrame:
    return facts.where(_matches(filters))


def exists(facts: DataFrame, **filters: Any) -> bool:
    return not get(facts, **filters).isEmpty()


def create(facts: DataFrame, keys: list[str], measures: list[str], **values: Any) -> DataFrame:
    """Add one record; a key that exists is an error."""
    if exists(facts, **{k: values[k] for k in keys}):
        raise ValueError("a record with this key already exists")
    types = dict(facts.dtypes)
    fields = [*keys, *measures]
    row = facts.sparkSession.createDataFrame(
        [tuple(values.get(f) for f in fields)], ", ".join(f"{f} {types[f]}" for f in fields)
    )
    return facts.unionByName(row, allowMissingColumns=True)


def update(facts: DataFrame, changes: dict[str, Any], **filters: Any) -> DataFrame:
    """Set measures on the records that match; None leaves a measure as it is."""
    hit = _matches(filters)
    types = dict(facts.dtypes)
    return facts.withColumns(
        {
            m: F.when(hit, F.lit(v).cast(types[m])).otherwise(F.col(m))
            for m, v in changes.items()
            if v is not None
        }
    )


def scan(
    facts: DataFrame,
    station_ids: list[Any] | None = None,
    start: int = 400,
    end: int = 2300,
    station: str = "station_id",
) -> DataFrame:
    """Facts of some stations within clock hours; both conditions are plain column predicates."""
    kept = facts.where(F.col("time").between(start, end))
    return kept.where(F.col(station).isin(station_ids)) if station_ids else kept


def ordered(facts: DataFrame, station: str = "station_id") -> DataFrame:
    return facts.orderBy(station, "year", "month", "day", "time")


def write(facts: DataFrame, path: str, station: str = "station_id") -> None:
    """Store by month, sorted within files so that row-group statistics prune by station and time.

    Only the months that ``facts`` contains are replaced. Rows of a month spread over several tasks by
    day, so that one busy month is not one task.
    """
    (
        facts.repartition("year", "month", "day")
        .sortWithinPartitions("year", "month", station, "time")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "month")
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

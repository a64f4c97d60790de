"""Daily ingest: unprocessed files to counts, dimension, facts and ledger in shared storage."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemeter.functions import columns as C
from tidemeter.operators import rates
from tidemeter.sources import facts, ledger, stations

CHECKINS = "daily_check_ins_counts_15min"
CHECKOUTS = "daily_check_outs_counts_15min"
ESTIMATES_IN = "daily_check_ins_estimates"
ESTIMATES_OUT = "daily_check_outs_estimates"
LEAVING = (CHECKOUTS, ESTIMATES_OUT)
RATE_COLUMNS = [*facts.COUNT_KEYS, *facts.RATE_MEASURES]
FACT_COLUMNS = [*facts.COUNT_KEYS, *facts.COUNT_MEASURES]
FACT_SCHEMA = (
    "year int, month int, day int, day_of_week int, time int, date_type string, station_id int, "
    "count_in bigint, count_out int, variance_in_1min double"
)


MINUTE_SCHEMA = "code string, minute timestamp, process_type string, n bigint, exits double"
STATION_SCHEMA = "id int, code string, name string"
MANIFEST_SCHEMA = "date date, version int"


@dataclass
class Store:
    """State before or after an ingest step; every part is a DataFrame. Facts follow from the minute sums."""

    stations: DataFrame
    facts: DataFrame
    ledger: DataFrame
    minutes: DataFrame


def empty_store(spark: SparkSession) -> Store:
    return Store(
        spark.createDataFrame([], STATION_SCHEMA),
        spark.createDataFrame([], FACT_SCHEMA),
        ledger.empty(spark),
        spark.createDataFrame([], MINUTE_SCHEMA),
    )


def minutes_of(rows: DataFrame, process_type: str) -> DataFrame:
    """Taps and exits per station code and minute: sums, so the parts of a day add up whatever files they come in.

    Two spellings of one station add up because grouping is by the parsed code.
    """
    keyed = rows.withColumn("code", C.station_code("station_field")).where("code IS NOT NULL AND ts IS NOT NULL")
    exits = F.sum("exits") if process_type in LEAVING else F.lit(None).cast("double")
    return keyed.groupBy("code", C.floor_minutes("ts", 1).alias("minute")).agg(F.count(F.lit(1)).alias("n"), exits.alias("exits")).select(
        "code", "minute", F.lit(process_type).alias("process_type"), "n", "exits"
    )


def facts_of(minutes: DataFrame, dimension: DataFrame) -> DataFrame:
    """Quarter-hour facts from all minute sums of their windows; several sums of one minute are added first."""
    added = minutes.groupBy("code", "minute", "process_type").agg(F.sum("n").alias("n"), F.sum("exits").alias("exits"))
    entering, leaving = F.col("process_type") == CHECKINS, F.col("process_type") == CHECKOUTS
    n = F.when(entering, F.col("n"))
    windows = added.groupBy(F.col("code").alias("station"), C.floor_minutes("minute", 15).alias("window")).agg(
        F.sum(n).alias("s"), F.sum(n * n).alias("q"), F.count(n).alias("m"), F.sum(F.when(leaving, F.col("exits"))).alias("exits")
    )
    s, q, m = F.col("s"), F.col("q"), F.col("m")
    variance = F.when(m > 1, (q - s * s / m) / (m - 1)).when(m == 1, 0.0)
    measured = windows.select(
        "station", "window", s.alias("count_in"), F.round("exits", 6).cast("int").alias("count_out"), variance.alias("variance_in_1min")
    )
    dated = rates.with_calendar(measured).withColumnRenamed("station", "code")
    named = stations.attach_station(dated, dimension).withColumnRenamed("id", "station_id")
    return named.select(*FACT_COLUMNS)


def rates_of(minutes: DataFrame, dimension: DataFrame, process_type: str) -> DataFrame:
    """Quarter-hour rates of one direction from minute sums: mean check-ins of the 5-minute bins that hold any, or exits per 5 minutes."""
    bins = minutes.where(F.col("process_type") == process_type).groupBy("code", C.floor_minutes("minute", 5).alias("bin")).agg(
        F.sum("n").alias("n"), F.sum("exits").alias("exits")
    )
    windows = bins.groupBy(F.col("code").alias("station"), C.floor_minutes("bin", 15).alias("window")).agg(
        F.avg("n").alias("lambda_in"), (F.sum("exits") / 3).alias("lambda_out")
    )
    measure = "lambda_out" if process_type in LEAVING else "lambda_in"
    dated = rates.with_calendar(windows.select("station", "window", F.col(measure).alias(f"estimated_{measure}")))
    named = stations.attach_station(dated.withColumnRenamed("station", "code"), dimension).withColumnRenamed("id", "station_id")
    return named.select(*facts.COUNT_KEYS, f"estimated_{measure}")


def ingest_rates(store: Store, table: DataFrame, rows: DataFrame, process_type: str) -> tuple[Store, DataFrame]:
    """Apply the files that the ledger does not list yet to a table of rates (``RATE_COLUMNS``); only the days they touch change.

    Check-ins and check-outs are ingested apart: each overwrites its own measure on known keys and leaves the other one. Counts stay.
    """
    after, added = _step(store, rows, process_type)
    after.facts = store.facts
    days = added.select(F.to_date("minute").alias("date")).distinct()
    touched = after.minutes.join(days, F.to_date("minute") == days["date"], "left_semi")
    merged = facts.upsert(table, rates_of(touched, after.stations, process_type), facts.COUNT_KEYS, facts.RATE_MEASURES)
    return after, merged


def empty_rates(spark: SparkSession) -> DataFrame:
    fields = dict(f.split() for f in FACT_SCHEMA.split(", "))
    return spark.createDataFrame([], ", ".join([*(f"{k} {fields[k]}" for k in facts.COUNT_KEYS), *(f"{m} double" for m in facts.RATE_MEASURES)]))


def days_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_date("ts").alias("date")).where("date IS NOT NULL").distinct()


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("date", F.make_date("year", "month", "day"))


def _step(store: Store, rows: DataFrame, process_type: str) -> tuple[Store, DataFrame]:
    """The store after the rows of files that its ledger does not list yet, and the minute sums they add."""
    files = rows.select(F.col("file_id").alias("filename"), F.lit(process_type).alias("process_type")).distinct()
    todo = ledger.unprocessed(files, store.ledger)
    fresh = rows.join(todo.select(F.col("filename").alias("file_id")), "file_id", "left_semi")
    dimension = stations.insert_members(store.stations, stations.members(fresh))
    added = minutes_of(fresh, process_type)
    days = days_of(fresh)
    sums = store.minutes.unionByName(added)
    touched = sums.join(days, F.to_date("minute") == days["date"], "left_semi")
    kept = _dated(store.facts).join(days, "date", "left_anti").select(*FACT_COLUMNS)
    done = ledger.mark_processed(store.ledger, todo)
    return Store(dimension, kept.unionByName(facts_of(touched, dimension)), done, sums), added


def ingest(store: Store, rows: DataFrame, process_type: str) -> Store:
    """Apply the rows of files that the ledger does not list yet.

    ``rows`` has ts, station_field and file_id, and exits when it holds check-outs. The facts of the days that the
    files touch are made again from all minute sums of those days, so a day may come in any number of files.
    """
    return _step(store, rows, process_type)[0]


def save(store: Store, folder: str, version: int, days: DataFrame | None = None, added: DataFrame | None = None) -> None:
    """Write a version: all days, or only the facts of ``days`` and the minute sums ``added`` since the version before.

    A version never changes files of another one, so a step that is lost halfway can be repeated. Its manifest names
    the version that holds each day's facts. A mark goes last: a version that has it is complete.
    """
    spark = store.facts.sparkSession
    dated = _dated(store.facts)
    changed = dated if days is None else dated.join(days, "date", "left_semi")
    (
        changed.repartition("date")
        .sortWithinPartitions("date", "station_id", "time")
        .write.mode("overwrite")
        .partitionBy("date")
        .parquet(f"{folder}/facts/version={version}")
    )
    sums = store.minutes if added is None else added
    sums.withColumn("date", F.to_date("minute")).write.mode("overwrite").partitionBy("date").parquet(f"{folder}/minutes/version={version}")
    store.stations.write.mode("overwrite").parquet(f"{folder}/stations/version={version}")
    named = (dated.select("date").distinct() if days is None else days).select("date", F.lit(version).alias("version"))
    if days is not None:
        named = named.unionByName(spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/manifest/version={version - 1}"))
    newest = named.groupBy("date").agg(F.max("version").cast("int").alias("version"))
    newest.write.mode("overwrite").parquet(f"{folder}/manifest/version={version}")
    store.ledger.write.mode("overwrite").parquet(f"{folder}/ledger/version={version}")
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{folder}/complete/version={version}")


def load(spark: SparkSession, folder: str, version: int) -> Store:
    """The store as of a version: the files of every day that its manifest names, found by partition."""
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/manifest/version={version}")
    rows = spark.read.schema(f"{FACT_SCHEMA}, date date, version int").parquet(f"{folder}/facts")
    sums = spark.read.schema(f"{MINUTE_SCHEMA}, date date, version int").parquet(f"{folder}/minutes")
    return Store(
        spark.read.schema(STATION_SCHEMA).parquet(f"{folder}/stations/version={version}"),
        rows.join(manifest, ["version", "date"], "left_semi").select(*FACT_COLUMNS),
        spark.read.schema(ledger.SCHEMA).parquet(f"{folder}/ledger/version={version}"),
        sums.where(F.col("version") <= version).select("code", "minute", "process_type", "n", "exits"),
    )


def advance(spark: SparkSession, folder: str, version: int, rows: DataFrame, process_types: tuple[str, ...]) -> int:
    """Apply rows to a version and write the next one; of the store, only the days that the rows touch are read and written."""
    days = days_of(rows)
    store = load(spark, folder, version)
    sums = spark.read.schema(f"{MINUTE_SCHEMA}, date date, version int").parquet(f"{folder}/minutes")
    sums = sums.where(F.col("version") <= version).join(days, "date", "left_semi")
    store.minutes = sums.select("code", "minute", "process_type", "n", "exits")
    store.facts = _dated(store.facts).join(days, "date", "left_semi").select(*FACT_COLUMNS)
    parts = []
    for process_type in process_types:
        store, added = _step(store, rows, process_type)
        parts.append(added)
    save(store, folder, version + 1, days, reduce(DataFrame.unionByName, parts))
    return version + 1


def newest_version(spark: SparkSession, folder: str) -> int | None:
    """The last complete version; None where there is no store."""
    try:
        return spark.read.schema("id bigint, version int").parquet(f"{folder}/complete").agg(F.max("version")).first()[0]
    except AnalysisException:
        return None


def begin(spark: SparkSession, folder: str) -> int:
    """The newest version of a store; an empty version 0 is written where there is none."""
    found = newest_version(spark, folder)
    if found is None:
        save(empty_store(spark), folder, 0)
        found = 0
    return found

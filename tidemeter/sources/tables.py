"""Readers: daily tap files (CSV or columnar), pre-aggregated exits, and the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemeter.functions import columns as C
from tidemeter.session import use_utc
from tidemeter.sources.daily_csv import read_daily_csv

# Column names of the daily files.
CHECKIN_COLUMNS = {"Fecha_Transaccion": "ts", "Estacion_Parada": "station_field", "Numero_Tarjeta": "card"}
CHECKOUT_COLUMNS = {"Fecha_Transaccion": "date", "Tiempo": "time", "Estacion": "station_field", "Salidas_S": "exits"}
SYNTHETIC_COLUMNS = {"Fecha_Hora_Transaccion": "ts", "Estacion": "station_field"}

CSV_TYPES = {"ts": "timestamp", "exits": "double"}

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_checkin_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per validation: ts, station_field, card, file_id."""
    return read_daily_csv(use_utc(spark), path, CHECKIN_COLUMNS, CSV_TYPES)


def read_checkout_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per gate and quarter hour: ts, station_field, exits, file_id."""
    raw = read_daily_csv(use_utc(spark), path, CHECKOUT_COLUMNS, CSV_TYPES)
    return raw.select(C.join_date_time("date", "time").alias("ts"), "station_field", "exits", "file_id")


def read_synthetic_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per simulated validation: ts, station_field, file_id."""
    return read_daily_csv(use_utc(spark), path, SYNTHETIC_COLUMNS, CSV_TYPES)


def select_files(df: DataFrame, file_ids: list[str] | None, file_id: str = "file_id") -> DataFrame:
    """Keep the named daily files; an empty selection keeps all."""
    return df.where(F.col(file_id).isin(file_ids)) if file_ids else df


def raw_field(event_type: str = "event_type"):
    """A ``"(code) name"`` field whose five-digit code is derived from the name."""
    code = F.ascii(event_type) * 100 + F.length(event_type)
    return F.concat(F.lit("("), F.lpad(code.cast("string"), 5, "0"), F.lit(") "), F.col(event_type))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return use_utc(spark).read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event table as taps: event_id, ts, card, station, station_field, exits."""
    return events(spark, sf_dir).select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("card"),
        F.col("event_type").alias("station"),
        raw_field().alias("station_field"),
        F.col("value").alias("exits"),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def order_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order table as a multi-year fact: station, ts, value with calendar keys."""
    ts = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("station"), ts.alias("ts"), *C.calendar_keys(ts), F.col("o_totalprice").alias("value")
    )

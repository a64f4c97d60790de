"""Station dimension: lookup and insertion of new members with surrogate ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.functions import columns as C
from tidemeter.operators.split import running_total
from tidemeter.session import stored


def by_code(stations: DataFrame, *codes: str) -> DataFrame:
    return stations.where(F.col("code").isin(*codes))


def by_id(stations: DataFrame, *ids: int) -> DataFrame:
    return stations.where(F.col("id").isin(*ids))


def members(taps: DataFrame, field: str = "station_field") -> DataFrame:
    """Distinct (code, name) of the raw field; one name per code."""
    parsed = taps.select(field).distinct().select(C.station_code(field).alias("code"), C.station_name(field).alias("name"))
    return parsed.where((F.col("code") != "") & (F.col("name") != "")).groupBy("code").agg(F.min("name").alias("name"))


def new_members(stations: DataFrame, found: DataFrame) -> DataFrame:
    """Members whose code the dimension does not hold yet."""
    return found.join(stations.select("code"), "code", "left_anti")


def insert_members(stations: DataFrame, found: DataFrame) -> DataFrame:
    """Dimension with unknown members appended; ids continue after the highest one, in code order."""
    fresh = stored(new_members(stations, found), "members").withColumn("_one", F.lit(1))
    numbered = running_total(fresh, [], ["code"], {"position": "_one"})
    top = stations.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    added = numbered.select((top + F.col("position")).cast("int").alias("id"), "code", "name")
    return stations.select("id", "code", "name").unionByName(added)


def create_station(stations: DataFrame, code: str, name: str) -> DataFrame:
    """Append one station; a code that exists is an error."""
    if not by_code(stations, code).isEmpty():
        raise ValueError(f"station code {code!r} already exists")
    row = stations.sparkSession.createDataFrame([(code, name)], "code string, name string")
    return insert_members(stations, row)


def attach_station(df: DataFrame, stations: DataFrame, on: str = "code", how: str = "inner") -> DataFrame:
    """Join facts to the dimension. The optimizer broadcasts the dimension when its size allows."""
    return df.join(stations, on, how)

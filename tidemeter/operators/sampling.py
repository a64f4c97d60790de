"""Stratified sample of days by month and day type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.functions.calendar import day_calendar


def days_between(df: DataFrame, ts: str) -> DataFrame:
    """All calendar days from the first to the last row."""
    span = df.agg(F.min(F.to_date(ts)).alias("a"), F.max(F.to_date(ts)).alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias("date"))


def stratified_days(days: DataFrame, per_stratum: int = 2, seed: int = 42) -> DataFrame:
    """Up to ``per_stratum`` working days, weekend days and holidays of every month.

    The order inside a stratum is a hash of the date. A month without weekend days contributes one more
    working day instead, which may coincide with a day already taken.
    """
    stratum = F.when(F.col("date_type").isin("SA", "SU"), "weekend").otherwise(F.col("date_type"))
    typed = day_calendar(days).select(
        "date", "date_type", F.year("date").alias("year"), F.month("date").alias("month"), stratum.alias("stratum"),
        F.md5(F.concat_ws("|", F.col("date").cast("string"), F.lit(str(seed)))).alias("draw"),
        F.md5(F.concat_ws("|", F.col("date").cast("string"), F.lit(str(seed + 1)))).alias("spare"),
    )
    place = F.row_number().over(Window.partitionBy("year", "month", "stratum").orderBy("draw"))
    spare_place = F.row_number().over(Window.partitionBy("year", "month", "stratum").orderBy("spare"))
    has_weekend = F.max((F.col("stratum") == "weekend").cast("int")).over(Window.partitionBy("year", "month")) == 1
    ranked = typed.withColumns({"place": place, "spare_place": spare_place, "has_weekend": has_weekend})
    chosen = (F.col("place") <= per_stratum) | (
        ~F.col("has_weekend") & (F.col("stratum") == "WD") & (F.col("spare_place") == 1)
    )
    return ranked.where(chosen).select("date", "date_type")

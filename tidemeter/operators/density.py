"""Density clustering of arrival times within a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.functions import columns as C
from tidemeter.operators.split import small

DAY = ["station", "date"]


def arrival_seconds(taps: DataFrame, start: int = 400, end: int = 2300) -> DataFrame:
    """Whole seconds since the first tap of each station-day, with tap counts and times.

    Taps of one second are merged, so a day is at most 86,400 rows before any sort. The first taps, a row a station-day, come
    to the taps where they are few, so taps themselves are not moved by station and day.
    """
    inside = taps.where(C.in_hours(C.hhmm("ts"), start, end)).withColumn("date", F.to_date("ts"))
    first = small(inside.groupBy(*DAY).agg(F.min("ts").alias("t0")), "first-taps")
    second = F.floor(C.seconds_between("ts", "t0")).cast("bigint")
    return inside.join(first, DAY).groupBy(*DAY, second.alias("sec")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.sum(C.seconds_between("ts", "t0")).alias("sum_s"),
        F.min("t0").alias("t0"),
    )


def neighbours(seconds: DataFrame, eps: int = 60) -> DataFrame:
    """Taps within eps seconds on either side, the tap itself included.

    A running total is read before the first and after the last second of every reach, so a second costs the same in
    crowded days; a frame of the reach would be added up anew for each.
    """
    marks = F.array(
        F.struct((F.col("sec") - eps).alias("at"), F.lit(0).alias("kind")),  # before what happens at that second
        F.struct(F.col("sec").alias("at"), F.lit(1).alias("kind")),
        F.struct((F.col("sec") + eps).alias("at"), F.lit(2).alias("kind")),  # after it
    )
    upto = Window.partitionBy(*DAY).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).over(upto)
    read = seconds.withColumn("_mark", F.explode(marks)).select("*", "_mark.at", "_mark.kind").withColumn("_total", total)
    kept = [F.max(F.when(F.col("kind") == 1, F.col(c))).alias(c) for c in seconds.columns if c not in (*DAY, "sec")]
    inside = F.max(F.when(F.col("kind") == 2, F.col("_total"))) - F.max(F.when(F.col("kind") == 0, F.col("_total")))
    return read.groupBy(*DAY, "sec").agg(*kept, inside.alias("neighbours"))


def clusters(seconds: DataFrame, eps: int = 60, min_samples: int = 3) -> DataFrame:
    """DBSCAN labels in one dimension, numbered from 0 in time order; noise is -1.

    A cluster is a run of dense seconds no more than eps apart. Other seconds join the run of the
    nearest dense second before them if it is within eps, else the one after.
    """
    order = Window.partitionBy(*DAY).orderBy("sec")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*DAY).orderBy(F.desc("sec")).rowsBetween(Window.unboundedPreceding, -1)  # runs backwards, read once
    dense = neighbours(seconds, eps).withColumn("core", F.col("neighbours") >= min_samples)
    core_sec = F.when(F.col("core"), F.col("sec"))
    placed = dense.withColumns({"prev": F.last(core_sec, True).over(past), "next": F.last(core_sec, True).over(ahead)})
    opens = F.col("core") & (F.col("prev").isNull() | (F.col("sec") - F.col("prev") > eps))
    runs = placed.withColumn("run", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    label = (
        F.when(F.col("core") | (F.col("sec") - F.col("prev") <= eps), F.col("run"))
        .when(F.col("next") - F.col("sec") <= eps, F.col("run") + 1)
        .otherwise(-1)
    )
    return runs.withColumn("cluster", label.cast("int")).drop("prev", "next", "run")


def cluster_summary(labelled: DataFrame) -> DataFrame:
    """Size, mean second after the day's first tap, and first and last tap of every cluster and of the noise."""
    return labelled.groupBy(*DAY, "cluster").agg(
        F.sum("n").alias("size"),
        (F.sum("sum_s") / F.sum("n")).alias("mean_s"),
        F.min_by("first_ts", "sec").alias("start"),
        F.max_by("last_ts", "sec").alias("end"),
    )

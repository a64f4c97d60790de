"""Kernel intensity on the minute grid, compensators, residuals and grid lookups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tidemeter.functions import columns as C
from tidemeter.operators.split import previous_row
from tidemeter.session import stored

FIRST_MINUTE, LAST_MINUTE = 240, 1380
GRID = LAST_MINUTE - FIRST_MINUTE + 1
DAY = ["station", "date"]


def open_taps(taps: DataFrame) -> DataFrame:
    """Taps within operating hours, with date and minute of day."""
    return taps.where(C.in_hours(C.hhmm("ts"))).withColumns(
        {"date": F.to_date("ts"), "minute": C.minute_of_day("ts")}
    )


def minute_counts(taps: DataFrame) -> DataFrame:
    """Taps per station, day and minute; at most 1141 rows a station-day, whatever the traffic."""
    return open_taps(taps).groupBy(*DAY, "minute").agg(F.count(F.lit(1)).alias("n"))


def minute_series(counts: DataFrame) -> DataFrame:
    """Every minute of the grid for every day seen: station, date, minute, n with zeros."""
    grid = F.explode(F.sequence(F.lit(FIRST_MINUTE), F.lit(LAST_MINUTE))).alias("minute")
    days = counts.select(*DAY).distinct().select(*DAY, grid)
    return days.join(counts, [*DAY, "minute"], "left").select(*DAY, "minute", F.coalesce("n", F.lit(0)).alias("n"))


SMOOTHED = StructType([StructField("n", ArrayType(LongType())), StructField("intensity", ArrayType(DoubleType()))])


def gaussian_smoother(bandwidth: float):
    """Column function: busy minutes and their counts to dense counts and kernel intensity on the grid."""
    offsets = np.arange(GRID)
    weights = np.exp(-0.5 * (offsets / bandwidth) ** 2) / (bandwidth * np.sqrt(2 * np.pi))

    @pandas_udf(SMOOTHED)
    def smooth(minutes: pd.Series, counts: pd.Series) -> pd.DataFrame:
        kernel = weights[np.abs(offsets[:, None] - offsets[None, :])]
        dense = np.zeros((len(minutes), GRID))
        for row, (m, n) in enumerate(zip(minutes, counts)):
            dense[row, np.asarray(m) - FIRST_MINUTE] = n
        return pd.DataFrame({"n": list(dense.astype(np.int64)), "intensity": list(dense @ kernel)})

    return smooth


def kernel_intensity(taps: DataFrame, bandwidth: float = 5.0) -> DataFrame:
    """Arrivals per minute by Gaussian kernel for every station-day: minute, n, intensity.

    The inputs are whole minutes, so the sum over taps is a convolution of 1141 counts with the kernel:
    one matrix product per batch of days instead of a pair of rows per tap and grid point.
    """
    busy = F.array_sort(F.collect_list(F.struct("minute", "n")))
    days = minute_counts(taps).groupBy(*DAY).agg(busy.alias("busy"))
    smoothed = days.select(*DAY, gaussian_smoother(bandwidth)(F.col("busy.minute"), F.col("busy.n")).alias("s"))
    both = smoothed.select(*DAY, F.posexplode(F.arrays_zip("s.n", "s.intensity")).alias("i", "p"))
    return both.select(*DAY, (F.col("i") + FIRST_MINUTE).alias("minute"), "p.n", "p.intensity")


def compensated(grid: DataFrame) -> DataFrame:
    """Add running counts, the compensator and the martingale residual along the grid of each day."""
    run = Window.partitionBy(*DAY).orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.withColumns({"total": F.sum("n").over(run), "compensator": F.sum("intensity").over(run)})
    return out.withColumn("residual", F.col("total") - F.col("compensator"))


def compensator_increments(grid: DataFrame) -> DataFrame:
    """Increments between consecutive taps, as weighted values.

    Taps of one minute share the grid value, so a minute with n taps gives one step from the previous
    busy minute and n - 1 zeros; ``weight`` carries those multiplicities. The first tap has no increment.
    """
    busy = compensated(grid).where("n > 0")
    step = F.col("compensator") - F.lag("compensator").over(Window.partitionBy(*DAY).orderBy("minute"))
    stepped = busy.withColumn("step", step)
    parts = F.array(
        F.struct(F.col("step").alias("delta"), F.when(F.col("step").isNotNull(), 1).otherwise(0).cast("bigint").alias("weight")),
        F.struct(F.lit(0.0).alias("delta"), (F.col("n") - 1).cast("bigint").alias("weight")),
    )
    long = stepped.select(*DAY, "minute", F.explode(parts).alias("p")).select(*DAY, "minute", "p.delta", "p.weight")
    return long.where("weight > 0").withColumn("pit", C.exponential_pit("delta"))


def at_minute(taps: DataFrame, grid: DataFrame, value: str) -> DataFrame:
    """Grid value at the minute of every tap."""
    return open_taps(taps).join(grid.select(*DAY, "minute", value), [*DAY, "minute"])


def interpolated(taps: DataFrame, grid: DataFrame, value: str, out: str) -> DataFrame:
    """Grid value at the exact time of every tap: linear between grid minutes, constant beyond the ends."""
    ahead = F.coalesce(F.lead(value).over(Window.partitionBy(*DAY).orderBy("minute")), F.col(value))
    edges = grid.select(*DAY, "minute", F.col(value).alias("_y"), ahead.alias("_y1"))
    joined = open_taps(taps).join(edges, [*DAY, "minute"])
    fraction = C.fractional_minute("ts") - F.col("minute")
    return joined.withColumn(out, F.col("_y") + (F.col("_y1") - F.col("_y")) * fraction).drop("_y", "_y1")


def trapezoid(grid: DataFrame, value: str = "intensity") -> DataFrame:
    """Running trapezoid integral of a value over the minute grid, 0 at its start."""
    day = Window.partitionBy(*DAY).orderBy("minute")
    area = F.coalesce((F.col(value) + F.lag(value).over(day)) / 2, F.lit(0.0))
    return grid.withColumn("_area", area).withColumn(
        "integral", F.sum("_area").over(day.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_area")


def binned_means(grid: DataFrame, minutes: int = 5) -> DataFrame:
    """Mean intensity and mean count by bins of the grid."""
    bin_no = F.floor((F.col("minute") - FIRST_MINUTE) / minutes).cast("int")
    return grid.groupBy(*DAY, bin_no.alias("bin")).agg(
        F.avg("intensity").alias("mean_lambda"), F.avg("n").alias("mean_count")
    )


def moment_k(series: DataFrame) -> DataFrame:
    """Moment estimate of dispersion from dense minute counts."""
    k = F.greatest((F.var_samp("n") - F.avg("n")) / (F.avg("n") * F.avg("n")), F.lit(0.0))
    return series.groupBy(*DAY).agg(F.avg("n").alias("mean"), F.var_samp("n").alias("var"), k.alias("k"))


def variance_curve(binned: DataFrame, k: DataFrame, points: int = 200) -> DataFrame:
    """Negative-binomial variance over an even grid of means up to the largest binned mean."""
    top = binned.groupBy(*DAY).agg(F.greatest(F.max("mean_lambda"), F.lit(1.0)).alias("top"))
    mu = F.lit(0.01) + (F.col("top") - 0.01) * F.col("i") / F.lit(float(points - 1))
    return (
        top.join(k.select(*DAY, "k"), DAY)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("mu", mu)
        .withColumn("variance", C.nb_variance("mu", "k"))
        .select(*DAY, "i", "mu", "variance")
    )


def rescaled_increments(taps: DataFrame, bandwidth: float = 5.0, tiebreak: str = "event_id") -> DataFrame:
    """Compensator differences between consecutive taps, interpolated at their exact times."""
    cumulative = trapezoid(kernel_intensity(taps, bandwidth))
    level = interpolated(taps, cumulative, "integral", "level").select(*DAY, "ts", tiebreak, "level")
    paired = previous_row(stored(level, "levels"), DAY, ["ts", tiebreak], ["level"], "before")
    return paired.select(*DAY, "ts", tiebreak, (F.col("level") - F.col("before.level")).alias("tau")).where("tau IS NOT NULL")

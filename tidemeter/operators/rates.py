"""Window counts, rates and dispersion tables per station."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.functions import columns as C
from tidemeter.functions.calendar import with_day_type

FACT_KEYS = ["station", "year", "month", "day", "day_of_week", "time", "date_type"]


def window_counts(taps: DataFrame, minutes: int, keys: list[str] | None = None) -> DataFrame:
    """Taps per station and fixed window; windows without taps have no row."""
    keys = keys or ["station"]
    return taps.groupBy(*keys, C.floor_minutes("ts", minutes).alias("w")).agg(F.count(F.lit(1)).alias("n"))


MAX_BINS = 20


def window_moments(taps: DataFrame, minutes: int, bin_minutes: int, total: str | None = None) -> DataFrame:
    """Per station and window: total ``s``, sum of squares ``q`` and number ``m`` of its non-empty bins.

    ``total`` names a column whose sum over the window is kept beside them, from the same scan.

    The bins of one window become counters of one aggregate, so map tasks send one row per station and
    window through a single shuffle. Windows with many bins are counted in two levels instead.
    """
    bins = minutes // bin_minutes
    if bins > MAX_BINS:
        n = F.col("n")
        summed = [F.sum(total).alias(total)] if total else []
        fine = taps.groupBy("station", C.floor_minutes("ts", bin_minutes).alias("w")).agg(F.count(F.lit(1)).alias("n"), *summed)
        return fine.groupBy("station", C.floor_minutes("w", minutes).alias("window")).agg(
            F.sum("n").alias("s"), F.sum(n * n).alias("q"), F.count("n").alias("m"), *summed
        )
    place = F.floor(F.pmod(F.unix_seconds("ts"), F.lit(minutes * 60)) / (bin_minutes * 60))
    names = [f"b{i}" for i in range(bins)]
    counted = taps.groupBy("station", C.floor_minutes("ts", minutes).alias("window")).agg(
        *[F.count_if(place == i).alias(name) for i, name in enumerate(names)], *([F.sum(total).alias(total)] if total else [])
    )
    columns = [F.col(name) for name in names]
    return counted.select(
        "station",
        "window",
        reduce(add, columns).alias("s"),
        reduce(add, [c * c for c in columns]).alias("q"),
        reduce(add, [(c > 0).cast("bigint") for c in columns]).alias("m"),
        *([total] if total else []),
    )


def _sample_variance() -> Column:
    """Variance of the non-empty bins, null when there is only one."""
    s, q, m = F.col("s"), F.col("q"), F.col("m")
    return F.when(m > 1, (q - s * s / m) / (m - 1))


def with_calendar(df: DataFrame, ts: str = "window") -> DataFrame:
    """Add the fact key columns of a window start."""
    return with_day_type(df.select("*", *C.calendar_keys(ts)), ts)


def rate_in(taps: DataFrame, minutes: int = 15, zero_fill: bool = False) -> DataFrame:
    """Mean of the 5-minute counts in each window.

    Only 5-minute bins with taps enter the mean; ``zero_fill`` divides by all bins of the window.
    """
    mean = F.col("s") / (F.lit(minutes / 5.0) if zero_fill else F.col("m"))
    return window_moments(taps, minutes, 5).select("station", "window", mean.alias("lambda_in"))


def rate_out(exits: DataFrame, minutes: int = 15) -> DataFrame:
    """Exits of a window per 5 minutes."""
    return exits.groupBy("station", C.floor_minutes("ts", minutes).alias("window")).agg(
        (F.sum("exits") / F.lit(minutes / 5.0)).alias("lambda_out")
    )


def counts_in(taps: DataFrame, minutes: int = 15, zero_fill: bool = False) -> DataFrame:
    """Window total and sample variance of its 1-minute counts.

    Minutes without taps are left out of the variance unless ``zero_fill``; a single minute gives 0.
    """
    if zero_fill:
        variance = (F.col("q") - F.col("s") * F.col("s") / float(minutes)) / (minutes - 1)
    else:
        variance = F.coalesce(_sample_variance(), F.lit(0.0))
    moments = window_moments(taps, minutes, 1)
    return moments.select("station", "window", F.col("s").alias("count_in"), variance.alias("variance_in_1min"))


def counts_out(exits: DataFrame, minutes: int = 15) -> DataFrame:
    """Window sum of exits cut to a whole number."""
    return exits.groupBy("station", C.floor_minutes("ts", minutes).alias("window")).agg(
        _whole_exits(F.sum("exits")).alias("count_out")
    )


def _whole_exits(total: Column) -> Column:
    """Rounding first keeps the cut independent of the order of summation."""
    return F.round(total, 6).cast("int")


def count_facts(taps: DataFrame, minutes: int = 15) -> DataFrame:
    """Check-in and check-out measures on one key, with calendar fields, in one aggregate over one scan."""
    moments = window_moments(taps, minutes, 1, "exits")
    measured = moments.select(
        "station",
        "window",
        F.col("s").alias("count_in"),
        F.coalesce(_sample_variance(), F.lit(0.0)).alias("variance_in_1min"),
        _whole_exits(F.col("exits")).alias("count_out"),
    )
    return with_calendar(measured)


def rate_facts(taps: DataFrame, minutes: int = 15) -> DataFrame:
    """Mean 5-minute check-ins and exits per 5 minutes on one key, with calendar fields, in one aggregate."""
    moments = window_moments(taps, minutes, 5, "exits")
    measured = moments.select(
        "station", "window", (F.col("s") / F.col("m")).alias("lambda_in"), (F.col("exits") / F.lit(minutes / 5.0)).alias("lambda_out")
    )
    return with_calendar(measured)


def overdispersion(taps: DataFrame, minutes: int = 15, start: int = 400, end: int = 2300) -> DataFrame:
    """Mean, variance, number and variance-to-mean ratio of 5-minute counts per window."""
    open_taps = taps.where(C.in_hours(C.hhmm("ts"), start, end))
    ratio = F.col("var") / F.col("mean")
    stats = window_moments(open_taps, minutes, 5).select(
        "station", "window", (F.col("s") / F.col("m")).alias("mean"), _sample_variance().alias("var"), F.col("m").alias("count")
    )
    return stats.withColumn("overdispersion", ratio)


def mean_overdispersion(taps: DataFrame, minutes: int = 15) -> DataFrame:
    return (
        overdispersion(taps, minutes)
        .groupBy("station")
        .agg(F.avg("overdispersion").alias("mean_overdispersion"))
        .withColumn("verdict", C.dispersion_verdict("mean_overdispersion"))
    )


def variance_to_mean(taps: DataFrame, minutes: int = 5) -> DataFrame:
    return window_counts(taps, minutes).groupBy("station").agg((F.var_samp("n") / F.avg("n")).alias("vmr"))


def rolling_rate(taps: DataFrame, last: int = 3) -> DataFrame:
    """Mean of the latest non-empty 5-minute counts, per station and day of data.

    A station-day has at most 288 windows, so the frame is bounded however many taps it holds.
    """
    w = Window.partitionBy("station", "date").orderBy("w").rowsBetween(-(last - 1), 0)
    return window_counts(taps, 5).withColumn("date", F.to_date("w")).withColumn("estimate", F.avg("n").over(w))


def sampled_rate(taps: DataFrame, tick_minutes: int = 15, last: int = 3) -> DataFrame:
    """Latest estimate of every station at each tick of the day, carried forward once it has been seen.

    Each estimate covers the ticks from its own window up to the next one, so the ticks are generated
    from the estimates and no grid is joined.
    """
    est = rolling_rate(taps, last)
    closing = est.groupBy("date").agg((F.max("w") + F.expr("INTERVAL 5 MINUTES")).alias("closing"))
    nxt = F.lead("w").over(Window.partitionBy("station", "date").orderBy("w"))
    spans = est.withColumn("next_w", nxt).join(closing, "date")
    first = C.ceil_minutes("w", tick_minutes)
    last_tick = C.floor_minutes(F.coalesce("next_w", "closing") - F.expr("INTERVAL 1 SECOND"), tick_minutes)
    step = F.expr(f"INTERVAL {tick_minutes} MINUTES")
    return (
        spans.where(first <= last_tick)
        .select("station", "date", F.explode(F.sequence(first, last_tick, step)).alias("tick"), "estimate")
    )


def leaderboard(taps: DataFrame, tick_minutes: int = 30, top: int = 3) -> DataFrame:
    """Stations with the highest rounded estimate at each tick."""
    ticks = sampled_rate(taps, tick_minutes).withColumn("estimate", F.round("estimate", 2))
    order = Window.partitionBy("tick").orderBy(F.desc("estimate"), "station")
    return ticks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)

"""Poisson-process diagnostics on event times: transforms, time rescaling, dispersion tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.functions import columns as C
from tidemeter.functions import special as S
from tidemeter.operators.goodness import ks_statistic
from tidemeter.operators.split import in_order, previous_row
from tidemeter.operators.trips import batches
from tidemeter.session import stored

SEGMENT = ["station", "date", "segment"]


def _windowed(taps: DataFrame, minutes: int, segment_minutes: int, at_least: int, tiebreak: str) -> DataFrame:
    """Taps with window, position, window size and the time of the tap before; windows with too few taps are dropped."""
    placed = taps.select("station", C.floor_minutes("ts", minutes).alias("window"), "ts", tiebreak, F.lit(1).alias("_one"))
    sizes = placed.groupBy("station", "window").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= at_least)
    ordered = in_order(placed, ["station", "window"], ["ts", tiebreak], totals={"j": "_one"}, before=("_before", ["ts"]))
    return ordered.join(sizes, ["station", "window"]).select(
        "station",
        F.to_date("window").alias("date"),
        F.floor(C.minute_of_day("window") / segment_minutes).cast("int").alias("segment"),
        "window",
        "size",
        "j",
        C.seconds_between("ts", "window").alias("t"),
        F.coalesce(C.seconds_between("_before.ts", "window"), F.lit(0.0)).alias("t_before"),
        F.lit(float(minutes * 60)).alias("length"),
    )


def arrival_transforms(
    taps: DataFrame, minutes: int = 5, segment_minutes: int = 60, at_least: int = 2, tiebreak: str = "event_id"
) -> DataFrame:
    """Conditional-uniform, logarithmic and Lewis-Durbin transforms of the taps of each window.

    With spacings c in rising order, Lewis' sum of (size + 2 - i) (c_i - c_(i - 1)) up to j is the sum of c up to j plus
    (size + 1 - j) c_j, so it takes one more order.
    """
    rows = _windowed(taps, minutes, segment_minutes, at_least, tiebreak)
    group = ["station", "window"]
    ratio = (F.col("length") - F.col("t")) / (F.col("length") - F.col("t_before"))
    timed = stored(
        rows.withColumn("cu", F.col("t") / F.col("length"))
        .withColumn("log_exp", -(F.col("size") + 1 - F.col("j")) * F.log(F.greatest(ratio, F.lit(1e-12)))),
        "transforms",
    )
    spacing = (F.col("t") - F.col("t_before")) / F.col("length")
    is_last = F.col("j") == F.col("size")
    tail = (F.col("length") - F.col("t")) / F.col("length")
    gaps = timed.select(
        *group, "size", F.explode(F.when(is_last, F.array(spacing, tail)).otherwise(F.array(spacing))).alias("c")
    )
    summed = in_order(gaps.withColumn("_one", F.lit(1)), group, ["c"], totals={"j": "_one", "_sum": "c"})
    lewis = F.col("_sum") + (F.col("size") + 1 - F.col("j")) * F.col("c")
    return timed.join(summed.select(*group, "j", lewis.alias("lewis")), [*group, "j"]).select(
        *SEGMENT, "window", "j", "size", "cu", "log_exp", "lewis"
    )


def arrival_tests(
    taps: DataFrame,
    minutes: int = 5,
    segment_minutes: int = 60,
    jitter_s: float = 0.0,
    batch_gap_s: float | None = None,
    at_least: int = 10,
    tiebreak: str = "event_id",
) -> DataFrame:
    """KS statistics of the three transforms per station, day and segment."""
    if jitter_s > 0:
        taps = taps.withColumn("ts", C.jitter("ts", tiebreak, width_s=jitter_s))
    if batch_gap_s is not None:
        taps = batches(taps, batch_gap_s, tiebreak=tiebreak)
    transformed = arrival_transforms(taps, minutes, segment_minutes, tiebreak=tiebreak)
    stacked = transformed.selectExpr(
        *SEGMENT, "stack(3, 'cu', cu, 'log', log_exp, 'lewis', lewis) AS (transform, x)"
    )
    keys = [*SEGMENT, "transform"]
    as_uniform = F.when(F.col("transform") == "log", C.exponential_pit("x")).otherwise(F.col("x"))
    tested = ks_statistic(stacked.withColumn("u", as_uniform), keys, "u", "uniform")
    return tested.where(F.col("n") >= at_least).withColumn("p_value", S.ks_sf(F.col("n"), F.col("d_stat")))


def piecewise_rescaled(
    taps: DataFrame, minutes: int = 5, segment_minutes: int = 60, at_least: int = 30, tiebreak: str = "event_id"
) -> DataFrame:
    """Increments of a piecewise-constant compensator at the taps of each segment.

    The compensator is zero at the segment's first window and linear inside each window, rising by the
    window's own count.
    """
    per_window = taps.groupBy("station", C.floor_minutes("ts", minutes).alias("window")).agg(F.count(F.lit(1)).alias("n"))
    segment = F.floor(C.minute_of_day("window") / segment_minutes).cast("int")
    placed = per_window.withColumn("date", F.to_date("window")).withColumn("segment", segment)
    seg = Window.partitionBy(*SEGMENT)
    edges = (
        placed.withColumn("base", F.coalesce(F.sum("n").over(seg.orderBy("window").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("size", F.sum("n").over(seg))
        .where(F.col("size") >= at_least)
    )
    rows = taps.withColumn("window", C.floor_minutes("ts", minutes)).join(edges, ["station", "window"])
    fraction = C.seconds_between("ts", "window") / F.lit(minutes * 60.0)
    level = rows.select(
        *SEGMENT, "window", "ts", tiebreak, (F.col("base") + F.col("n") * fraction).alias("level")
    )
    paired = previous_row(level, SEGMENT, ["ts", tiebreak], ["level"], "before", taps.count())
    return paired.select(*SEGMENT, "ts", tiebreak, (F.col("level") - F.col("before.level")).alias("tau")).where("tau IS NOT NULL")


def event_gaps(taps: DataFrame, keys: list[str], tiebreak: str = "event_id") -> DataFrame:
    """Seconds since the previous tap of the key."""
    paired = previous_row(taps, keys, ["ts", tiebreak], ["ts"], "before")
    return paired.withColumn("gap_s", C.seconds_between("ts", "before.ts")).drop("before")


def cameron_trivedi(minute_counts: DataFrame, keys: list[str]) -> DataFrame:
    """Regression of squared Pearson residuals on hourly means: slope, z and one-sided p.

    ``minute_counts`` is dense (keys, minute, n); hours without taps have no residual. The result is
    null where the mean does not vary.
    """
    hourly = minute_counts.withColumn(
        "mu", F.avg("n").over(Window.partitionBy(*keys, F.floor(F.col("minute") / 60)))
    ).where("mu > 0")
    sq = hourly.withColumn("r2", (F.col("n") - F.col("mu")) * (F.col("n") - F.col("mu")) / F.col("mu"))
    fit = sq.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("m"),
        F.regr_sxx("r2", "mu").alias("sxx"),
        F.regr_syy("r2", "mu").alias("syy"),
        F.regr_sxy("r2", "mu").alias("sxy"),
    )
    slope = F.when(F.col("sxx") > 1e-12, F.col("sxy") / F.col("sxx"))
    unexplained = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    # a perfect fit or fewer than three minutes leave no standard error
    spread = F.try_divide(F.try_divide(unexplained, F.col("m") - 2), F.col("sxx"))
    z = F.when(spread > 1e-18, F.col("slope") / F.sqrt(spread))
    scored = fit.withColumn("slope", slope).withColumn("z", z)
    return scored.select(*keys, "m", "slope", "z", S.normal_sf(F.col("z")).alias("p_value"))


def poisson_versus_nb(counts: DataFrame, keys: list[str], factor: str | None = "hour") -> DataFrame:
    """AIC of Poisson and unit-dispersion negative-binomial models with one mean per level of a factor, or with an intercept only.

    A factor with every level free makes the averages of its levels the fitted means of both families, so the
    likelihoods are sums over counts. ``counts`` is (keys, factor, n), non-empty windows only.
    """
    levels = [factor] if factor else []
    means = counts.groupBy(*keys, *levels).agg(F.avg("n").alias("mu"))
    rows = counts.join(means, [*keys, *levels])
    n, mu = F.col("n").cast("double"), F.col("mu")
    poisson = n * F.log(mu) - mu - S.lgamma(n + 1)
    geometric = n * F.log(mu / (1 + mu)) - F.log(1 + mu)
    pearson = (n - mu) * (n - mu)
    params = 2 * F.count_distinct(factor) if factor else F.lit(2)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"),
        (params - 2 * F.sum(poisson)).alias("poisson_aic"),
        (params - 2 * F.sum(geometric)).alias("nb_aic"),
        F.sum(pearson / mu).alias("poisson_chi2"),
        F.sum(pearson / (mu + mu * mu)).alias("nb_chi2"),
        (F.var_samp("n") / F.avg("n")).alias("vmr"),
    )

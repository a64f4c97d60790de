"""Daily curves: building, resampling, averaging, mean value functions and forecast accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.functions import columns as C
from tidemeter.functions.columns import let

DAY_KEYS = ["station", "year", "month", "day", "day_of_week", "date_type"]


def daily_curves(facts: DataFrame, value: str, min_points: int = 70, start: int = 400, end: int = 2300) -> DataFrame:
    """One ordered array of values per station and day; days with too few slots are dropped.

    A day has at most 96 slots, so the collected array is bounded by the clock, not by the taps.
    """
    slots = F.array_sort(F.collect_list(F.struct("time", F.col(value).alias("v"))))
    grouped = facts.where(C.in_hours("time", start, end)).groupBy(*DAY_KEYS).agg(slots.alias("slots"))
    return grouped.where(F.size("slots") >= min_points).select(
        *DAY_KEYS, F.transform("slots", lambda s: s["v"].cast("double")).alias("curve"), F.size("slots").alias("n_points")
    )


def expected_points(start: int, end: int, minutes: int = 15) -> int:
    """Slots between two HHMM clock times, both included."""
    to_minutes = lambda t: t // 100 * 60 + t % 100
    return (to_minutes(end) - to_minutes(start)) // minutes + 1


def _total(curve: Column) -> Column:
    return F.aggregate(curve, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def normalise(curve: Column) -> Column:
    """Divide by the sum; curves without positive mass stay as they are."""
    scaled = lambda c, t: F.when(t > 0, F.transform(c, lambda x: x / t)).otherwise(c)
    return let(curve, lambda c: let(_total(c), lambda t: scaled(c, t)))


def _lerp(curve: Column, last: Column, position: Column) -> Column:
    """Value at a fractional zero-based position between 0 and ``last``."""
    lower = F.least(F.floor(position).cast("int"), last)
    a, b = F.get(curve, lower), F.get(curve, F.least(lower + 1, last))
    return a + (b - a) * (position - lower)


def fill_gaps(curve: Column) -> Column:
    """Replace nulls by linear interpolation between valid neighbours, the nearest one at the ends."""

    def known(c: Column) -> Column:
        numbered = F.transform(c, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        return F.filter(numbered, lambda s: s["x"].isNotNull())

    def value(k: Column, x: Column, i: Column) -> Column:
        left = F.get(F.reverse(F.filter(k, lambda s: s["i"] < i)), F.lit(0))
        right = F.get(F.filter(k, lambda s: s["i"] > i), F.lit(0))
        between = left["x"] + (right["x"] - left["x"]) * (i - left["i"]) / (right["i"] - left["i"])
        return F.coalesce(x, between, left["x"], right["x"])

    def filled(c: Column) -> Column:
        repaired = let(known(c), lambda k: F.transform(c, lambda x, i: value(k, x, i)))
        return F.when(F.exists(c, lambda x: x.isNull()), repaired).otherwise(c)

    return let(curve, filled)


def resample(curve: Column, target_len: int = 77) -> Column:
    """Linear resampling of a curve on [0, 1] to a fixed number of points."""
    grid = F.sequence(F.lit(0), F.lit(target_len - 1))
    step = F.lit(float(max(target_len - 1, 1)))
    return let(
        curve, lambda c: F.transform(grid, lambda i: _lerp(c, F.size(c) - 1, i * (F.size(c) - 1) / step))
    )


def aligned_curves(curves: DataFrame, target_len: int = 77, min_valid: int = 70, unit_sum: bool = True) -> DataFrame:
    """Gap-filled, optionally normalised curves of equal length."""
    valid = F.size(F.filter("curve", lambda x: x.isNotNull()))
    shaped = normalise(F.col("curve")) if unit_sum else F.col("curve")
    kept = curves.where(valid >= min_valid).withColumn("curve", shaped)
    return kept.withColumn("curve", fill_gaps(F.col("curve"))).withColumn("curve", resample(F.col("curve"), target_len))


def points(curves: DataFrame, keys: list[str]) -> DataFrame:
    """Long form of curves: one row per position."""
    return curves.select(*keys, F.posexplode("curve").alias("pos", "v"))


def signatures(aligned: DataFrame) -> DataFrame:
    """Mean curve per station and day type."""
    mean = points(aligned, ["station", "date_type"]).groupBy("station", "date_type", "pos").agg(F.avg("v").alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return mean.groupBy("station", "date_type").agg(F.transform(ordered, lambda s: s["v"]).alias("curve"))


def range_signatures(
    facts: DataFrame, value: str, start: int = 400, end: int = 2300, minutes: int = 15, min_fraction: float = 0.5, unit_sum: bool = True
) -> DataFrame:
    """Signatures of a part of the day: curves need a fraction of the slots that the range can hold."""
    expected = expected_points(start, end, minutes)
    required = int(expected * min_fraction)
    daily = daily_curves(facts, value, required, start, end)
    return signatures(aligned_curves(daily, expected, required, unit_sum))


def feature_columns(sigs: DataFrame, length: int) -> DataFrame:
    """Curve positions as columns t_00, t_01, ..."""
    return sigs.select("station", "date_type", *[F.get("curve", F.lit(i)).alias(f"t_{i:02d}") for i in range(length)])


def dense_slots(facts: DataFrame, measures: list[str], keys: list[str] | None = None) -> DataFrame:
    """Every observed day of a group at every slot the group was seen on, missing measures as 0.

    Slots travel as one short array per group (at most one entry per window of the day), so densifying
    is a join on the group key and an explode.
    """
    keys = keys or ["station", "date_type"]
    date = C.date_of("year", "month", "day").alias("date")
    rows = facts.select(*keys, date, "time", *[F.coalesce(m, F.lit(0)).alias(m) for m in measures])
    slots = rows.groupBy(*keys).agg(F.collect_set("time").alias("slots"))
    grid = rows.select(*keys, "date").distinct().join(slots, keys).select(*keys, "date", F.explode("slots").alias("time"))
    filled = grid.join(rows, [*keys, "date", "time"], "left")
    return filled.select(*keys, "date", "time", *[F.coalesce(m, F.lit(0)).alias(m) for m in measures])


def average_curve(dense: DataFrame, measures: list[str], minutes: int = 15) -> DataFrame:
    """Mean count per slot and mean per-minute intensity."""
    means = [F.avg(m).alias(f"mean_{m}") for m in measures]
    rates = [(F.avg(m) / F.lit(float(minutes))).alias(f"rate_{m}") for m in measures]
    return dense.groupBy("station", "date_type", "time").agg(*means, *rates)


def mean_value_function(dense: DataFrame, measure: str) -> DataFrame:
    """Cumulative count within each day, averaged over days."""
    day = Window.partitionBy("station", "date_type", "date").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = dense.withColumn("cum", F.sum(measure).over(day))
    return cumulative.groupBy("station", "date_type", "time").agg(F.avg("cum").alias("m"))


def integrate(rates: DataFrame, keys: list[str], t: str, rate: str) -> DataFrame:
    """Cumulative sum of a rate times the mean step of its grid; grids hold a few hundred points a day."""
    group = Window.partitionBy(*keys)
    ordered = group.orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    step = F.try_divide((F.max(t).over(group) - F.min(t).over(group)).cast("double"), F.count(t).over(group) - 1)
    return rates.withColumn("m", F.sum(rate).over(ordered) * step)


def window_totals(samples: DataFrame, keys: list[str], t: str, rate: str, minutes: int = 15) -> DataFrame:
    """Rate samples summed into half-open windows and scaled by the sampling step."""
    group = Window.partitionBy(*keys)
    step = F.try_divide((F.max(t).over(group) - F.min(t).over(group)).cast("double"), F.count(t).over(group) - 1)
    slot = (F.floor(F.col(t) / minutes) * minutes).cast("int")
    return (
        samples.withColumn("_step", step)
        .groupBy(*keys, slot.alias("minute"))
        .agg(F.sum(F.col(rate) * F.col("_step")).alias("predicted"))
    )


def accuracy(pairs: DataFrame, keys: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MAE, RMSE, MAPE over positive actuals, and R squared."""
    y, yhat = F.col(actual), F.col(predicted)
    err = y - yhat
    sst = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)
    return pairs.groupBy(*keys).agg(
        F.count(y).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.when(y > 0, F.abs(err) / y)) * 100).alias("mape"),
        F.when(sst > 0, 1 - F.sum(err * err) / sst).alias("r2"),
    )


def holdout_split(facts: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Earlier days for fitting and the latest day of every group for comparison."""
    keys = keys or ["station", "date_type"]
    dated = facts.withColumn("date", C.date_of("year", "month", "day"))
    latest = dated.groupBy(*keys).agg(F.max("date").alias("held_out"))
    marked = dated.join(latest, keys)
    return marked.where("date < held_out").drop("held_out"), marked.where("date = held_out").drop("held_out")


def evaluate_average_curve(facts: DataFrame, measure: str, minutes: int = 15) -> DataFrame:
    """Accuracy of the average curve of earlier days on the latest day of each station and day type."""
    open_facts = facts.where(C.in_hours("time"))
    train, test = holdout_split(open_facts)
    predicted = average_curve(dense_slots(train, [measure]), [measure], minutes)
    pairs = test.select("station", "date_type", "time", F.coalesce(measure, F.lit(0)).alias("actual")).join(
        predicted.withColumnRenamed(f"mean_{measure}", "predicted"), ["station", "date_type", "time"]
    )
    return accuracy(pairs, ["station", "date_type"])


def slot_dispersion(dense: DataFrame, measure: str) -> DataFrame:
    """Size r per slot from mean and population variance across days; the group median where not overdispersed."""
    stats = dense.groupBy("station", "date_type", "time").agg(F.avg(measure).alias("mu"), F.var_pop(measure).alias("var"))
    r = F.when(F.col("var") > F.col("mu"), F.col("mu") * F.col("mu") / (F.col("var") - F.col("mu")))
    group = Window.partitionBy("station", "date_type")  # at most one row for each slot of the day
    over = F.avg(F.when(F.col("r").isNotNull(), 1.0).otherwise(0.0)).over(group)
    sized = stats.withColumn("r", r).withColumns({"median_r": F.median("r").over(group), "over_share": over})
    return sized.withColumn("r", F.coalesce("r", "median_r"))


def daily_dispersion(dense: DataFrame, measure: str, variance: str, minutes: int = 15) -> DataFrame:
    """Size r per slot as the median over days of mu^2 / (var - mu), with fallbacks and floor."""
    mu, var = F.col(measure) / F.lit(float(minutes)), F.col(variance)
    r_day = dense.withColumn("r_day", F.when(var > mu, mu * mu / (var - mu)))
    slots = r_day.groupBy("station", "date_type", "time").agg(F.median("r_day").alias("r_slot"))
    typical = F.median("r_slot").over(Window.partitionBy("station", "date_type"))  # at most one row for each slot of the day
    r = F.greatest(F.coalesce("r_slot", "typical", F.lit(1e6)), F.lit(1e-6))
    return slots.withColumn("typical", typical).select("station", "date_type", "time", r.alias("r"))


def global_dispersion(slot_r: DataFrame) -> DataFrame:
    return slot_r.groupBy("station", "date_type").agg(F.median("r").alias("r"))


def overdispersed_share(dense: DataFrame, measure: str, variance: str, minutes: int = 15) -> DataFrame:
    """Slots where some day has more variance than mean."""
    over = F.bool_or(F.col(variance) > F.col(measure) / F.lit(float(minutes)))
    slots = dense.groupBy("station", "date_type", "time").agg(over.alias("over"))
    return slots.groupBy("station", "date_type").agg(
        F.count(F.lit(1)).alias("slots"),
        F.count_if("over").alias("overdispersed"),
        F.avg(F.col("over").cast("int")).alias("share"),
    )

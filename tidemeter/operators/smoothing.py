"""Smoothed intensity and mean value functions: the smoothest cubic curve within a residual budget.

A group is one station and day type with one row per slot of the day, at most 96. The second derivatives of a smoothing
curve solve a symmetric system of five bands (Reinsch), which two folds over the slots solve: one forwards for the
factors, one backwards for the solution. All of it is expressions over arrays of one row a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemeter.functions import columns as C
from tidemeter.functions.columns import let
from tidemeter.operators.curves import accuracy, average_curve, dense_slots, holdout_split, integrate, mean_value_function, window_totals
from tidemeter.operators.split import spread

KEYS = ["station", "date_type"]
#: Bounds of the log penalty, and halvings between them.
LOW, HIGH, HALVINGS = -25.0, 40.0, 80


def _at(values: Column, i: Column) -> Column:
    """Entry of an array, 0 beyond its ends."""
    return F.coalesce(F.get(values, i), F.lit(0.0))


def bands(x: Column, y: Column) -> Column:
    """The system's parts at every inner knot: r0, r1 of the roughness, q0, q1, q2 of the second differences, and b = Q'y."""

    def row(j: Column) -> Column:
        h, k = F.get(x, j + 1) - F.get(x, j), F.get(x, j + 2) - F.get(x, j + 1)
        b = (F.get(y, j + 2) - F.get(y, j + 1)) / k - (F.get(y, j + 1) - F.get(y, j)) / h
        return F.struct(
            ((h + k) / 3).alias("r0"), (k / 6).alias("r1"), (1 / h).alias("q0"), (-1 / h - 1 / k).alias("q1"), (1 / k).alias("q2"), b.alias("b")
        )

    return F.transform(F.sequence(F.lit(0), F.size(x) - 3), row)


def squared_bands(rows: Column) -> Column:
    """The parts with the three bands d0, d1, d2 of Q'Q."""

    def row(e: Column, j: Column) -> Column:
        one, two = F.get(rows, j + 1), F.get(rows, j + 2)
        d0 = e["q0"] * e["q0"] + e["q1"] * e["q1"] + e["q2"] * e["q2"]
        d1 = F.coalesce(e["q1"] * one["q0"] + e["q2"] * one["q1"], F.lit(0.0))
        return F.struct(*[e[c].alias(c) for c in ("r0", "r1", "b")], d0.alias("d0"), d1.alias("d1"), F.coalesce(e["q2"] * two["q0"], F.lit(0.0)).alias("d2"))

    return F.transform(rows, row)


def second_derivatives(squared: Column, penalty: Column) -> Column:
    """Solution of (R + penalty Q'Q) g = Q'y at the inner knots."""
    pivot = lambda d, e, f, z: F.struct(d.alias("d"), e.alias("e"), f.alias("f"), z.alias("z"))
    none = pivot(*[F.lit(0.0)] * 4)
    start = F.struct(F.array().cast("array<struct<d:double,e:double,f:double,z:double>>").alias("list"), none.alias("p"), none.alias("q"))

    def forwards(acc: Column, row: Column) -> Column:
        p, q = acc["p"], acc["q"]
        d = row["r0"] + penalty * row["d0"] - p["d"] * p["e"] * p["e"] - q["d"] * q["f"] * q["f"]
        made = let(d, lambda d: pivot(d, (row["r1"] + penalty * row["d1"] - p["d"] * p["e"] * p["f"]) / d, penalty * row["d2"] / d, row["b"] - p["e"] * p["z"] - q["f"] * q["z"]))
        return let(made, lambda m: F.struct(F.array_append(acc["list"], m).alias("list"), m.alias("p"), p.alias("q")))

    def backwards(acc: Column, m: Column) -> Column:
        g = m["z"] / m["d"] - m["e"] * acc["g1"] - m["f"] * acc["g2"]
        return let(g, lambda g: F.struct(F.array_append(acc["g"], g).alias("g"), g.alias("g1"), acc["g1"].alias("g2")))

    empty = F.struct(F.array().cast("array<double>").alias("g"), F.lit(0.0).alias("g1"), F.lit(0.0).alias("g2"))
    factors = F.aggregate(squared, start, forwards)["list"]
    return F.reverse(F.aggregate(F.reverse(factors), empty, backwards)["g"])


def bend(rows: Column, g: Column) -> Column:
    """Q g: what a unit of penalty takes from every value."""
    n = F.size(rows) + 2
    part = lambda j, q: F.coalesce(F.get(rows, j)[q] * F.get(g, j), F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: part(i, "q0") + part(i - 1, "q1") + part(i - 2, "q2"))


def _sum_squares(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v * v)


def _line(x: Column, y: Column) -> Column:
    """Least-squares straight line at the knots."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda t, a: t + a)
    n = F.size(x)

    def fitted(mx: Column, my: Column) -> Column:
        sxy = total(F.zip_with(x, y, lambda a, b: (a - mx) * (b - my)))
        sxx = total(F.transform(x, lambda a: (a - mx) * (a - mx)))
        return let(sxy / sxx, lambda slope: F.transform(x, lambda a: my + slope * (a - mx)))

    return let(total(x) / n, lambda mx: let(total(y) / n, lambda my: fitted(mx, my)))


def smooth_within(x: Column, y: Column, budget: float) -> Column:
    """Struct of knot values, second derivatives at the inner knots, and sse: the natural cubic curve of least roughness within the budget.

    The budget is met by bisection on the log penalty; a straight line is taken when it already fits.
    """
    result = lambda v, g, sse: F.struct(v.alias("value"), g.alias("g"), sse.alias("sse"))

    def penalised(rows: Column, squared: Column) -> Column:
        taken = lambda at: F.transform(bend(rows, second_derivatives(squared, F.exp(at))), lambda v: v * F.exp(at))

        def halve(box: Column) -> Column:
            middle = (box["low"] + box["high"]) / 2
            half = lambda at, fits: F.struct(F.when(fits, at).otherwise(box["low"]).alias("low"), F.when(fits, box["high"]).otherwise(at).alias("high"))
            return let(middle, lambda at: let(_sum_squares(taken(at)) <= budget, lambda fits: half(at, fits)))

        start = F.struct(F.lit(LOW).alias("low"), F.lit(HIGH).alias("high"))
        best = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, lambda box, _: halve(box))["low"]
        solved = lambda at: let(second_derivatives(squared, F.exp(at)), lambda g: F.struct(g.alias("g"), F.transform(bend(rows, g), lambda v: v * F.exp(at)).alias("off")))
        made = lambda s: result(F.zip_with(y, s["off"], lambda a, b: a - b), s["g"], _sum_squares(s["off"]))
        return let(best, lambda at: let(solved(at), made))

    def fitted(rows: Column, squared: Column, line: Column) -> Column:
        sse = _sum_squares(F.zip_with(y, line, lambda a, b: a - b))
        flat = F.transform(rows, lambda _: F.lit(0.0))
        exact = result(y, second_derivatives(squared, F.lit(0.0)), F.lit(0.0))
        chosen = penalised(rows, squared) if budget > 0 else exact
        return let(sse, lambda sse: F.when(sse <= budget, result(line, flat, sse)).otherwise(chosen))

    few = result(y, F.array().cast("array<double>"), F.lit(0.0))
    many = let(bands(x, y), lambda rows: let(squared_bands(rows), lambda squared: let(_line(x, y), lambda line: fitted(rows, squared, line))))
    return F.when(F.size(x) < 3, few).otherwise(many)


def smooth_curves(curves: DataFrame, t: str, value: str, budget: float, density: int = 3) -> DataFrame:
    """Fit every station and day type and evaluate value and slope on an even grid with ``density`` points per slot."""
    rows = curves.select(*KEYS, F.struct(F.col(t).cast("double").alias("x"), F.col(value).cast("double").alias("y")).alias("p"))
    groups = spread(rows, KEYS).groupBy(*KEYS).agg(F.array_sort(F.collect_list("p")).alias("p"))
    arrays = groups.select(*KEYS, F.transform("p", lambda p: p["x"]).alias("x"), F.transform("p", lambda p: p["y"]).alias("y"))
    fitted = arrays.select(*KEYS, "x", smooth_within(F.col("x"), F.col("y"), budget).alias("fit"))
    n, last = F.size("x"), F.size("x") * density - 1
    ends = F.array_min("x"), F.array_max("x")
    grid = fitted.withColumn("i", F.explode(F.sequence(F.lit(0), last)))
    placed = grid.withColumn("t", ends[0] + (ends[1] - ends[0]) * F.col("i") / last)
    below = F.size(F.filter("x", lambda v: v <= F.col("t"))) - 1
    placed = placed.withColumn("j", F.greatest(F.least(below, n - 2), F.lit(0)))
    j, v, g = F.col("j"), F.col("fit.value"), F.col("fit.g")
    named = placed.select(
        *KEYS, "i", "t", n.alias("n"), F.get("x", j).alias("x0"), F.get("x", j + 1).alias("x1"), F.get(v, j).alias("v0"), F.get(v, j + 1).alias("v1"),
        _at(g, j - 1).alias("g0"), _at(g, j).alias("g1"), F.col("fit.sse").alias("sse"),
    )
    h = F.col("x1") - F.col("x0")
    a, b = (F.col("x1") - F.col("t")) / h, (F.col("t") - F.col("x0")) / h
    at = a * F.col("v0") + b * F.col("v1") + ((a * a * a - a) * F.col("g0") + (b * b * b - b) * F.col("g1")) * h * h / 6
    slope = (F.col("v1") - F.col("v0")) / h + ((1 - 3 * a * a) * F.col("g0") + (3 * b * b - 1) * F.col("g1")) * h / 6
    alone = F.col("n") < 2
    return named.select(
        *KEYS, "i", "t", F.when(alone, F.col("v0")).otherwise(at).alias("value"), F.when(alone, F.lit(0.0)).otherwise(slope).alias("slope"), "sse"
    )


def intensity_then_mvf(facts: DataFrame, measure: str, budget: float = 5.0, minutes: int = 15) -> DataFrame:
    """Smoothed intensity from average counts, and the mean value function integrated from it."""
    mean = average_curve(dense_slots(facts.where(C.in_hours("time")), [measure]), [measure], minutes)
    curves = mean.withColumn("x", C.hhmm_to_minutes("time"))
    smooth = smooth_curves(curves, "x", f"rate_{measure}", budget).withColumnRenamed("value", "intensity").drop("slope")
    return integrate(smooth, KEYS, "t", "intensity")


def mvf_then_intensity(facts: DataFrame, measure: str, budget: float = 5.0) -> DataFrame:
    """Smoothed mean value function from cumulative counts, and the intensity as its derivative."""
    m = mean_value_function(dense_slots(facts.where(C.in_hours("time")), [measure]), measure)
    curves = m.withColumn("x", C.hhmm_to_minutes("time"))
    smooth = smooth_curves(curves, "x", "m", budget)
    return smooth.withColumnRenamed("value", "m").withColumnRenamed("slope", "intensity")


def evaluate_smooth_intensity(facts: DataFrame, measure: str, budget: float = 10.0, minutes: int = 15) -> DataFrame:
    """Accuracy of integrated smooth intensity on the latest day of each station and day type."""
    train, test = holdout_split(facts.where(C.in_hours("time")))
    predicted = window_totals(intensity_then_mvf(train, measure, budget, minutes), KEYS, "t", "intensity", minutes)
    actual = test.select(*KEYS, C.hhmm_to_minutes("time").alias("minute"), F.coalesce(measure, F.lit(0)).alias("actual"))
    return accuracy(actual.join(predicted, [*KEYS, "minute"]), KEYS)

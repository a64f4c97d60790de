"""Bootstrap, likelihood and residuals of negative-binomial minute counts, all as expressions.

A group is the minute grid of one station-day: at most 1141 minutes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemeter.functions import columns as C
from tidemeter.functions import special as S
from tidemeter.functions.columns import let
from tidemeter.operators.intensity import DAY
from tidemeter.operators.split import spread

#: Weights of a Poisson bootstrap end here: a larger one has a chance below 1e-11.
MOST_WEIGHT = 13
#: A prime; a resample maps the key of a row, below it, by a line modulo the prime, so weights of two rows are independent.
PRIME = 2**31 - 1


def poisson_bounds() -> list[float]:
    """Chances that a Poisson variable of mean one is at most 0, 1, 2, ..."""
    terms = [math.exp(-1) / math.factorial(k) for k in range(MOST_WEIGHT)]
    return [sum(terms[: k + 1]) for k in range(MOST_WEIGHT)]


def bootstrap_weight(u: Column) -> Column:
    """Number of times that a row with uniform number ``u`` enters a resample."""
    weight = F.lit(MOST_WEIGHT)
    for k, bound in reversed(list(enumerate(poisson_bounds()))):
        weight = F.when(u < F.lit(bound), F.lit(k)).otherwise(weight)
    return weight


def resample_lines(replicates: int) -> list[tuple[int, int]]:
    """Slope and offset of every resample's line: powers of two primitive roots of the prime."""
    return [(pow(16807, r + 1, PRIME), pow(48271, r + 1, PRIME)) for r in range(replicates)]


def bootstrap_k(series: DataFrame, replicates: int = 200, seed: int = 42) -> DataFrame:
    """Mean and 95 percent interval of the moment dispersion over resampled minutes.

    Every minute enters every resample with a Poisson weight from a hash of its key and the number of the resample, so all
    resamples are one aggregate and the result does not depend on partitioning.
    """
    key = F.floor(C.unit_hash(*DAY, "minute", seed=seed) * F.lit(float(PRIME)))
    lines = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in resample_lines(replicates)])
    drawn = series.select(*DAY, "n", key.alias("key")).select(*DAY, "n", "key", F.posexplode(lines).alias("r", "line"))
    u = ((F.col("key") * F.col("line.a") + F.col("line.b")) % PRIME) / F.lit(float(PRIME))
    w, n = F.col("w"), F.col("n")
    weighted = drawn.select(*DAY, "r", "n", bootstrap_weight(u).alias("w")).where("w > 0")
    sums = weighted.groupBy(*DAY, "r").agg(F.sum(w).alias("size"), F.sum(w * n).alias("total"), F.sum(w * n * n).alias("square"))
    mean = F.col("total") / F.col("size")
    var = (F.col("square") - F.col("total") * mean) / (F.col("size") - 1)
    k = F.when((F.col("total") > 0) & (F.col("size") > 1), F.greatest((var - mean) / (mean * mean), F.lit(0.0))).otherwise(F.lit(0.0))
    at = F.percentile("k", [0.025, 0.975])
    # Added in their order: sums of doubles follow the order of rows, and that follows the partitions.
    mean_k = F.aggregate(F.array_sort(F.collect_list("k")), F.lit(0.0), lambda total, x: total + x) / F.count("k")
    return sums.select(*DAY, k.alias("k")).groupBy(*DAY).agg(mean_k.alias("k_mean"), at.alias("q")).select(
        *DAY, "k_mean", F.col("q")[0].alias("k_low"), F.col("q")[1].alias("k_high")
    )


def _below(n: Column) -> Column:
    """0, 1, ..., n - 1; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _sum(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + term(x))


def nb_score(grid: Column, k: Column) -> Column:
    """Derivative of the log-likelihood in log k, up to a positive factor, over structs (n, m) of counts and means.

    Differences of digamma functions at whole distances are finite sums, so no series is needed.
    """

    def term(e: Column) -> Column:
        n, m = e["n"], e["m"]
        gammas = F.when(n > 0, _sum(_below(n), lambda j: k / (1 + k * j))).otherwise(F.lit(0.0))
        return F.log1p(k * m) - k * (m - n) / (1 + k * m) - gammas

    return _sum(grid, term)


def nb_log_likelihood(grid: Column, k: Column) -> Column:
    """Log-likelihood of counts with the given means and dispersion k over structs (n, m)."""

    def term(e: Column) -> Column:
        n, m = e["n"], e["m"]
        gammas = F.when(n > 0, _sum(_below(n), lambda j: F.log1p(k * j))).otherwise(F.lit(0.0))
        return gammas + n * F.log(m) - S.lgamma(n + F.lit(1.0)) - (n + 1 / k) * F.log1p(k * m)

    return _sum(grid, term)


#: Halvings of the range of log k.
HALVINGS = 50


def fit_k(grid: DataFrame, low: float = 1e-8, high: float = 1e3) -> DataFrame:
    """Maximum-likelihood dispersion given the intensity at every minute: the place in log k where the score crosses zero.

    A day whose score is not positive at ``low`` is not overdispersed and gets ``low``.
    """
    minute = F.struct("n", F.greatest(F.col("intensity"), F.lit(1e-6)).alias("m"))
    days = spread(grid, DAY).groupBy(*DAY).agg(F.collect_list(minute).alias("grid"))

    def halve(box: Column) -> Column:
        middle = (box["low"] + box["high"]) / 2
        rises = lambda at: nb_score(F.col("grid"), F.exp(at)) > 0
        half = lambda up, at: F.struct(F.when(up, at).otherwise(box["low"]).alias("low"), F.when(up, box["high"]).otherwise(at).alias("high"))
        return let(middle, lambda at: let(rises(at), lambda up: half(up, at)))

    steps = F.sequence(F.lit(1), F.lit(HALVINGS))
    start = F.struct(F.lit(math.log(low)).alias("low"), F.lit(math.log(high)).alias("high"))
    found = days.withColumn("box", F.aggregate(steps, start, lambda box, _: halve(box)))
    fitted = found.select(*DAY, "grid", F.exp(F.col("box.low")).alias("k"))
    return fitted.select(*DAY, "k", nb_log_likelihood(F.col("grid"), F.col("k")).alias("loglik"))


def randomised_pit(grid: DataFrame, k: DataFrame, seed: int = 42) -> DataFrame:
    """Dunn-Smyth residual of every minute: a uniform draw inside the jump of the count distribution.

    The distribution is summed by the recurrence of its probabilities; the draw is a hash of the row key.
    """
    rows = grid.join(k.select(*DAY, "k"), DAY)
    mu = F.greatest(F.col("intensity"), F.lit(1e-6))
    rows = rows.withColumn("r", 1 / F.greatest(F.col("k"), F.lit(1e-8))).withColumn("q", mu / (mu + F.col("r")))
    start = F.exp(F.col("r") * F.log1p(-F.col("q")))
    zero = F.struct(start.alias("p"), F.lit(0.0).alias("below"))
    steps = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n").cast("int"))).otherwise(F.array().cast("array<int>"))
    ends = F.aggregate(
        steps,
        zero,
        lambda acc, i: F.struct(
            (acc["p"] * (i - 1 + F.col("r")) / i * F.col("q")).alias("p"), (acc["below"] + acc["p"]).alias("below")
        ),
    )
    placed = rows.withColumn("_e", ends)
    u = F.least(F.lit(1.0), F.col("_e.below") + C.unit_hash(*DAY, "minute", seed=seed) * F.col("_e.p"))
    return placed.select(*DAY, "minute", "n", u.alias("u"))

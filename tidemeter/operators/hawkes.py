"""Self-exciting process with an exponential kernel over a fixed baseline, per station and day.

Event times have second resolution, so a day is at most 68,460 distinct seconds with multiplicities,
however many taps it holds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.functions import columns as C
from tidemeter.operators.goodness import ks_test, ljung_box, shifted_correlation
from tidemeter.operators.intensity import DAY, LAST_MINUTE, kernel_intensity, open_taps, trapezoid
from tidemeter.operators.split import spread
from tidemeter.session import stored

#: Bounds of alpha and beta, per minute.
LOW, HIGH = 1e-8, 1e3


def event_seconds(taps: DataFrame) -> DataFrame:
    """Taps per station, day and second, with the time in minutes."""
    seconds = open_taps(taps).groupBy(*DAY, "minute", C.second_of_day("ts").alias("second")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return seconds.withColumn("t", F.col("second") / 60.0)


def with_baseline(seconds: DataFrame, grid: DataFrame) -> DataFrame:
    """Baseline intensity and its integral at every event second, linear between grid minutes."""
    day = Window.partitionBy(*DAY).orderBy("minute")
    ahead = lambda c: F.coalesce(F.lead(c).over(day), F.col(c))
    edges = trapezoid(grid).select(
        *DAY, "minute", F.col("intensity").alias("y"), ahead("intensity").alias("y1"),
        F.col("integral").alias("a"), ahead("integral").alias("a1"),
        F.max("integral").over(Window.partitionBy(*DAY)).alias("mass"),
    )
    f = F.col("t") - F.col("minute")
    return seconds.join(edges, [*DAY, "minute"]).select(
        *DAY, "second", "t", "n",
        (F.col("y") + (F.col("y1") - F.col("y")) * f).alias("mu"),
        (F.col("a") + (F.col("a1") - F.col("a")) * f).alias("base"),
        "mass",
    )


#: Largest exponent of one chunk of the scan; what lies two chunks back weighs less than exp(-SPAN).
SPAN = 500.0


def decayed(events: DataFrame, keys: list[str], beta: str = "beta") -> DataFrame:
    """``s``: earlier taps of the key at the first tap of every second, each weighted by exp(-beta * age in minutes).

    A scan over pairs of (decay, sum): within chunks of time in which beta spans ``SPAN`` the sum is a running total of
    growing weights, a chunk hands its total to the next one with the decay between them, and each row adds both.
    """
    first = events.groupBy(*keys).agg(F.min("t").alias("_t0"))
    width = F.lit(SPAN) / F.col(beta)
    rows = events.join(first, keys).withColumn("_u", F.col("t") - F.col("_t0"))
    rows = rows.withColumn("_chunk", F.floor(F.col("_u") / width)).withColumn("_in", F.col(beta) * (F.col("_u") - F.col("_chunk") * width))
    grown = F.col("n") * F.exp("_in")
    by_chunk = [*keys, "_chunk"]
    within = Window.partitionBy(*by_chunk).orderBy("second").rowsBetween(Window.unboundedPreceding, -1)
    handed = rows.groupBy(*keys, (F.col("_chunk") + 1).alias("_chunk")).agg(F.sum(grown).alias("_handed"))
    both = rows.withColumn("_own", F.coalesce(F.sum(grown).over(within), F.lit(0.0))).join(handed, by_chunk, "left")
    s = (F.col("_own") + F.coalesce("_handed", F.lit(0.0)) * math.exp(-SPAN)) * F.exp(-F.col("_in"))
    return both.withColumn("s", s).drop("_t0", "_u", "_chunk", "_in", "_own", "_handed")


#: Cells on each side of the first likelihood grid and of the later ones, and rounds, each of which halves the step around the best cell.
WIDE, NARROW, ROUNDS = 13, 5, 12
#: Log-likelihoods are compared to so many digits; ties go to the smaller beta, then to the smaller alpha.
DIGITS = 6


#: Taps whose intensities are held at once.
HELD = 1 << 20


def _sums_before(at: np.ndarray, n: np.ndarray, beta: float) -> np.ndarray:
    """The scan of ``decayed`` for the seconds of one day, counted from its first, and one beta."""
    width = min(int(SPAN * 60 / beta), int(at[-1]) + 1)
    counts = np.zeros((int(at[-1]) // width + 1, width))
    counts.ravel()[at] = n
    grow = np.exp(beta * np.arange(width) / 60.0)
    total = np.cumsum(counts * grow, axis=1)
    earlier = np.zeros_like(total)
    earlier[:, 1:] = total[:, :-1]
    earlier[1:] += total[:-1, -1:] * math.exp(-beta * width / 60.0)
    return (earlier / grow).ravel()[at]


def _box_cells(low: float, step: float, cells: int) -> np.ndarray:
    return np.exp(low + np.arange(cells) * step)


def _likeliest(second: np.ndarray, n: np.ndarray, mu: np.ndarray, mass: float, end: float) -> tuple[float, float, float]:
    """alpha, beta and log-likelihood of one day by a grid that is narrowed around its best cell, up to the cells beside it."""
    at, t, upto = second - second[0], second / 60.0, np.cumsum(n)
    bottom, top = math.log(LOW), math.log(HIGH)
    b = a = bottom
    step, cells = (top - bottom) / (WIDE - 1), WIDE
    for _ in range(ROUNDS + 1):
        betas, alphas = _box_cells(b, step, cells), _box_cells(a, step, cells)
        before = [_sums_before(at, n, beta) for beta in betas]
        exposure = np.array([(n * (1 - np.exp(-beta * (end - t))) / beta).sum() for beta in betas])
        value = -mass - exposure[:, None] * alphas[None, :]
        for start in range(0, int(upto[-1]), HELD):
            tap = np.arange(start, min(start + HELD, int(upto[-1])))
            of = np.searchsorted(upto, tap, side="right")
            later = tap - (upto - n)[of]  # further taps of one second stand one higher each
            for i, s in enumerate(before):
                x = s[of] + later
                value[i] += [np.log(mu[of] + alpha * x).sum() for alpha in alphas]
        value = np.round(value, DIGITS)
        i, j = divmod(int(value.argmax()), cells)
        best = (float(alphas[j]), float(betas[i]), float(value[i, j]))
        half = step / 2
        b, a = (min(max(x - half * (NARROW // 2), bottom), top - half * (NARROW - 1)) for x in (b + i * step, a + j * step))
        step, cells = half, NARROW
    return best


def fit(taps: DataFrame, bandwidth: float = 5.0, end: float = float(LAST_MINUTE)) -> DataFrame:
    """Rows per event second with the fitted parameters of its day and the rescaled gap ``tau``, as a stored table.

    The log-likelihood is taken on a grid over the whole range of log alpha and log beta, which is narrowed ``ROUNDS``
    times. A task does this for the seconds of a day, which the clock bounds, in arrays. ``tau`` is the gap
    from the previous event second; the other taps of the same second follow at distance 0. A day whose best alpha is its
    lower bound has no excitation that could tell beta, which is then its upper bound.
    """
    events = stored(with_baseline(event_seconds(taps), kernel_intensity(taps, bandwidth)), "hawkes-events")
    types = dict(events.dtypes)

    def likeliest(key: tuple, day: pd.DataFrame) -> pd.DataFrame:
        day = day.sort_values("second")
        second, n = (day[c].to_numpy().astype(np.int64) for c in ("second", "n"))
        found = _likeliest(second, n, day["mu"].to_numpy(), day["mass"].max(), max(end, second[-1] / 60.0))
        return pd.DataFrame([[*key, int(n.sum()), *found]], columns=[*DAY, "events", "alpha", "beta", "loglik"])

    schema = ", ".join(f"{k} {types[k]}" for k in DAY) + ", events long, alpha double, beta double, loglik double"
    days = spread(events.select(*DAY, "second", "n", "mu", "mass"), DAY).groupBy(*DAY)
    fitted = days.applyInPandas(likeliest, schema)
    fitted = fitted.withColumn("beta", F.when(F.col("alpha") < 2 * LOW, F.lit(HIGH)).otherwise(F.col("beta")))
    rows = decayed(events.join(fitted, DAY), DAY)
    day = Window.partitionBy(*DAY).orderBy("second")
    earlier = F.coalesce(F.sum("n").over(day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = F.col("base") + F.col("alpha") / F.col("beta") * (earlier - F.col("s"))
    rows = rows.withColumn("level", level).withColumn("tau", F.col("level") - F.lag("level").over(day))
    return stored(rows.select(*DAY, "second", "t", "n", "tau", "alpha", "beta", "loglik", "events"), "hawkes-fit")


def parameters(fitted: DataFrame) -> DataFrame:
    """One row per station-day: alpha, beta, branching ratio, log-likelihood, events."""
    return fitted.groupBy(*DAY).agg(
        *[F.max(c).alias(c) for c in ("alpha", "beta", "loglik", "events")]
    ).withColumn("branching", F.col("alpha") / F.col("beta"))


def diagnostics(fitted: DataFrame, lags: tuple[int, ...] = (10, 20, 30)) -> DataFrame:
    """KS test of the positive rescaled gaps and Ljung-Box of their PIT, per station-day."""
    gaps = fitted.where("tau > 0").withColumn("pit", C.exponential_pit("tau"))
    ks = ks_test(gaps, DAY, "tau", "expon")
    box = ljung_box(gaps, DAY, ["second"], "pit", lags)
    wide = box.groupBy(*DAY).agg(
        *[F.max(F.when(F.col("lag") == k, F.col("q_stat"))).alias(f"q{k}") for k in lags],
        *[F.max(F.when(F.col("lag") == k, F.col("p_value"))).alias(f"q{k}_p") for k in lags],
    )
    return ks.join(wide, DAY, "left")


def residual_autocorrelation(fitted: DataFrame, lags: int = 39) -> DataFrame:
    gaps = fitted.where("tau > 0").withColumn("pit", C.exponential_pit("tau"))
    return shifted_correlation(gaps, DAY, ["second"], "pit", list(range(1, lags + 1)))


def decay_sums(taps: DataFrame, betas: list[float]) -> DataFrame:
    """Exponential-decay recursion S = exp(-beta gap)(1 + S) over each day's taps, per beta: the last value and the sum over taps.

    Further taps of one second stand one higher each.
    """
    rows = event_seconds(taps).withColumn("beta", F.explode(F.array(*[F.lit(float(b)) for b in betas])))
    n = F.col("n")
    scanned = decayed(rows, [*DAY, "beta"])
    return scanned.groupBy(*DAY, "beta").agg(
        F.max_by(F.col("s") + n - 1, "second").alias("s_last"), F.sum(n * F.col("s") + n * (n - 1) / 2).alias("s_total")
    )

"""Distribution tests on samples of any size, and autocorrelation of bounded series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.functions import columns as C
from tidemeter.functions import special as S
from tidemeter.functions.columns import let
from tidemeter.operators.split import rank_ranges, running_total, value_histogram
from tidemeter.session import stored

CDFS = {
    "uniform": lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)),
    "expon": lambda x: F.when(x > 0, C.exponential_pit(x)).otherwise(F.lit(0.0)),
}


def ks_statistic(df: DataFrame, keys: list[str], value: str, cdf: str, weight: str | None = None) -> DataFrame:
    """Largest distance between the empirical distribution and a fixed one.

    Equal values are merged before ranking. ``weight`` gives how often a row's value occurs.
    """
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    hist = stored(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(amount.alias("c")), "values")
    ranked = running_total(hist, keys, [value], {"upto": "c"}).withColumn("f", CDFS[cdf](F.col(value)))
    sizes = hist.groupBy(*keys).agg(F.sum("c").alias("n"))
    n = F.col("n")
    gap = F.greatest(F.col("upto") / n - F.col("f"), F.col("f") - (F.col("upto") - F.col("c")) / n)
    return ranked.join(sizes, keys).groupBy(*keys).agg(F.max("n").alias("n"), F.max(gap).alias("d_stat"))


def ks_test(df: DataFrame, keys: list[str], value: str, cdf: str, at_least: int = 1, weight: str | None = None) -> DataFrame:
    tested = ks_statistic(df, keys, value, cdf, weight=weight).where(F.col("n") >= at_least)
    return tested.withColumn("p_value", S.ks_sf(F.col("n"), F.col("d_stat")))


def empirical_cdf(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values with the share of rows not above them."""
    sizes = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    ranked = rank_ranges(df, keys, value)
    return ranked.join(sizes, keys).withColumn("ecdf", F.col("upto") / F.col("size"))


def quantile_pairs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Observed values against uniform, exponential and normal quantiles at the middle of their rank range."""
    ranked = empirical_cdf(df, keys, value)
    p = (F.col("upto") - F.col("n") / 2) / F.col("size")
    with_p = ranked.withColumn("p", p)
    return with_p.select(
        *keys,
        value,
        "n",
        "ecdf",
        F.col("p").alias("q_uniform"),
        (-F.log(1 - F.col("p"))).alias("q_expon"),
        S.normal_ppf(F.col("p")).alias("q_normal"),
    )


def normality_moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """D'Agostino's K squared from sample skewness and kurtosis, with its exact exponential tail."""
    stats = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("n"), F.skewness(value).alias("g1"), (F.kurtosis(value) + 3).alias("b2")
    )
    n = F.col("n").cast("double")
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta2 - 1))
    delta = 1 / F.sqrt(0.5 * F.log(w2))
    scaled = y / F.sqrt(2 / (w2 - 1))
    z_skew = delta * F.log(scaled + F.sqrt(scaled * scaled + 1))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("b2") - mean) / F.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    denominator = 1 + x * F.sqrt(2 / (a - 4))
    cube = F.signum(denominator) * F.pow((1 - 2 / a) / F.abs(denominator), F.lit(1 / 3))
    z_kurt = ((1 - 2 / (9 * a)) - cube) / F.sqrt(2 / (9 * a))
    tested = stats.where("n >= 8 AND g1 IS NOT NULL AND NOT isnan(g1)").withColumn("z_skew", z_skew).withColumn("z_kurt", z_kurt)
    k2 = F.col("z_skew") * F.col("z_skew") + F.col("z_kurt") * F.col("z_kurt")
    return tested.select(*keys, "n", k2.alias("k2"), F.exp(-k2 / 2).alias("k2_p"))


RANK_BLOCK = 4096


def normality_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Shapiro-Wilk, Anderson-Darling and Kolmogorov-Smirnov against the fitted normal.

    Everything is a weighted sum over distinct values with their rank ranges. Normal scores of a long
    run of equal values are summed in blocks of ranks, so no single row expands without bound.
    """
    fitted = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("size"),
        F.avg(value).alias("mu"),
        F.stddev_samp(value).alias("sd"),
        F.var_pop(value).alias("var_pop"),
    ).where("size >= 3 AND sd > 0")
    ranked = rank_ranges(df, keys, value).join(fitted, keys)
    n, c, hi = F.col("size").cast("double"), F.col("n"), F.col("upto")
    lo = hi - c
    z = (F.col(value) - F.col("mu")) / F.col("sd")
    tails = let(z, lambda v: F.struct(S.normal_cdf(v).alias("below"), S.normal_sf(v).alias("above")))
    scored = ranked.withColumn("_t", tails).select("*", "_t.below", "_t.above").drop("_t")
    ad_low = (hi * hi - lo * lo) / n * F.log("below")
    ad_high = (c * (2 * n + 1) - (hi * (hi + 1) - lo * (lo + 1))) / n * F.log("above")
    blocks = scored.select(
        *keys, "size", "mu", "sd", "var_pop", F.col(value).alias("x"), lo.alias("lo"), hi.alias("hi"),
        (ad_low + ad_high).alias("ad"),
        F.greatest(hi / n - F.col("below"), F.col("below") - lo / n).alias("gap"),
        F.explode(F.sequence(lo, hi - 1, F.lit(RANK_BLOCK))).alias("from"),
    )
    score = lambda i: S.normal_ppf((i - 0.375) / (F.col("size") + 0.25))
    ranks = F.sequence(F.col("from") + 1, F.least(F.col("from") + RANK_BLOCK, F.col("hi")))
    pair = F.aggregate(
        F.transform(ranks, score),
        F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("mm")),
        lambda acc, m: F.struct((acc["m"] + m).alias("m"), (acc["mm"] + m * m).alias("mm")),
    )
    first_block = F.col("from") == F.col("lo")
    at = lambda k: F.max(F.when((F.col("lo") < k) & (F.col("hi") >= k), F.col("x")))
    joined = blocks.withColumn("p", pair).groupBy(*keys).agg(
        *[F.max(m).alias(m) for m in ("size", "var_pop")],
        (-F.max("size") - F.sum(F.when(first_block, F.col("ad")))).alias("anderson"),
        F.max("gap").alias("ks"),
        F.sum(F.col("x") * F.col("p.m")).alias("mx"),
        F.sum("p.mm").alias("mm"),
        *[at(k).alias(name) for k, name in ((F.lit(1), "x1"), (F.lit(2), "x2"), (F.col("size") - 1, "xm"), (F.col("size"), "xn"))],
    )
    return _finish_normality(joined, keys)


def _polynomial(coefficients: list[float], x: Column) -> Column:
    acc = F.lit(coefficients[0])
    for k in coefficients[1:]:
        acc = acc * x + F.lit(k)
    return acc


# Royston's corrections of the two outer Shapiro-Wilk weights, highest power of 1/sqrt(n) first.
OUTER_WEIGHT = [-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0]
SECOND_WEIGHT = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0]
# Royston's normalising polynomials for log(1 - W), in n up to 11 and in log n from 12.
SMALL_MEAN, SMALL_SD = [-0.0006714, 0.025054, -0.39978, 0.5440], [-0.0020322, 0.062767, -0.77857, 1.3822]
LARGE_MEAN, LARGE_SD = [0.0038915, -0.083751, -0.31082, -1.5861], [0.0030302, -0.082676, -0.4803]
# Fixed value: Anderson-Darling 5 percent point for a fitted normal.
ANDERSON_5PCT = 0.752


def _shapiro() -> Column:
    """Shapiro-Wilk W from the aggregated sums; every intermediate is named once, as its formula is long."""
    n, large = F.col("size").cast("double"), F.col("size") > 5
    u = 1 / F.sqrt(n)
    span, inner = F.col("xn") - F.col("x1"), F.col("xm") - F.col("x2")
    scores = F.array(S.normal_ppf((n - 0.375) / (n + 0.25)), S.normal_ppf((n - 1.375) / (n + 0.25)))

    def weights(m: Column) -> Column:
        first = m[0] / F.sqrt("mm") + _polynomial(OUTER_WEIGHT, u)
        second = F.when(large, m[1] / F.sqrt("mm") + _polynomial(SECOND_WEIGHT, u)).otherwise(F.lit(0.0))
        return F.array(F.when(F.col("size") == 3, F.lit(0.5**0.5)).otherwise(first), second)

    def statistic(m: Column, a: Column) -> Column:
        m2 = F.when(large, m[1]).otherwise(F.lit(0.0))
        eps = (F.col("mm") - 2 * m[0] * m[0] - 2 * m2 * m2) / (1 - 2 * a[0] * a[0] - 2 * a[1] * a[1])
        body = F.when(F.col("size") > 3, (F.col("mx") - span * m[0] - inner * m2) / F.sqrt(eps)).otherwise(F.lit(0.0))
        square = lambda w: F.least(F.lit(1.0), w * w / (F.col("var_pop") * n))
        return let(body + a[0] * span + a[1] * inner, square)

    return let(scores, lambda m: let(weights(m), lambda a: statistic(m, a)))


def _shapiro_p(w: Column) -> Column:
    n = F.col("size").cast("double")
    lw, ln = F.log(1 - w), F.log(n)
    small = (-F.log(-2.273 + 0.459 * n - lw) - _polynomial(SMALL_MEAN, n)) / F.exp(_polynomial(SMALL_SD, n))
    large = (lw - _polynomial(LARGE_MEAN, ln)) / F.exp(_polynomial(LARGE_SD, ln))
    return let(F.when(F.col("size") <= 11, small).otherwise(large), S.normal_sf)


def _finish_normality(joined: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col("size").cast("double")
    critical = F.round(F.lit(ANDERSON_5PCT) / (1 + 0.75 / n + 2.25 / n / n), 3)
    both = let(_shapiro(), lambda w: F.struct(w.alias("w"), F.when(F.col("size") > 3, _shapiro_p(w)).alias("p")))
    tested = joined.withColumn("_sw", both)
    return tested.select(
        *keys,
        F.col("size").alias("n"),
        F.col("_sw.w").alias("shapiro"),
        F.col("_sw.p").alias("shapiro_p"),
        "anderson",
        (F.col("anderson") > critical).alias("anderson_reject"),
        "ks",
        S.kolmogorov_sf(n, F.col("ks")).alias("ks_p"),
    )


def normality(df: DataFrame, keys: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """The whole battery with rejection flags; small samples get the note ``small_sample``."""
    ranks, moments = normality_ranks(df, keys, value), normality_moments(df, keys, value)
    both = ranks.join(moments.drop("n"), keys, "left")
    flags = [(F.col(f"{t}_p") < alpha).alias(f"{t}_reject") for t in ("shapiro", "k2", "ks")]
    return both.select("*", *flags, F.when(F.col("n") < 8, "small_sample").alias("note"))


# --- serial dependence of series that the clock bounds ------------------------------------------


def _lagged(df: DataFrame, keys: list[str], order: list[str], value: str, lags: list[int]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select(*keys, F.col(value).alias("x"), *[F.lag(value, k).over(w).alias(f"l{k}") for k in lags])


def shifted_correlation(df: DataFrame, keys: list[str], order: list[str], value: str, lags: list[int]) -> DataFrame:
    """Pearson correlation of the series with itself shifted, one row per lag; null where a side does not vary.

    For series bounded by the clock (minutes or seconds of a day); all lags share one sort.
    """
    pairs = ", ".join(f"{k}, l{k}" for k in lags)
    long = _lagged(df, keys, order, value, lags).selectExpr(*keys, "x", f"stack({len(lags)}, {pairs}) AS (lag, y)")
    moments = long.where("y IS NOT NULL").groupBy(*keys, "lag").agg(
        F.regr_sxy("x", "y").alias("sxy"), F.regr_sxx("x", "y").alias("sxx"), F.regr_syy("x", "y").alias("syy")
    )
    return moments.select(*keys, "lag", F.try_divide("sxy", F.sqrt(F.col("sxx") * F.col("syy"))).alias("acf"))


def ljung_box(df: DataFrame, keys: list[str], order: list[str], value: str, lags: tuple[int, ...] = (10, 20, 30)) -> DataFrame:
    """Ljung-Box Q and p-value at several lags, with autocorrelations about the overall mean."""
    ks = list(range(1, max(lags) + 1))
    mean = F.avg(value).over(Window.partitionBy(*keys))
    centred = df.select(*keys, *order, (F.col(value) - mean).alias("_c"))
    lagged = _lagged(centred, keys, order, "_c", ks)
    sums = lagged.groupBy(*keys).agg(
        F.count("x").alias("n"),
        F.sum(F.col("x") * F.col("x")).alias("c0"),
        *[F.sum(F.col("x") * F.col(f"l{k}")).alias(f"c{k}") for k in ks],
    )
    long = sums.selectExpr(*keys, "n", "c0", f"stack({len(ks)}, {', '.join(f'{k}, c{k}' for k in ks)}) AS (k, ck)")
    term = F.col("ck") * F.col("ck") / (F.col("c0") * F.col("c0")) / (F.col("n") - F.col("k"))
    terms = long.where("k < n AND c0 > 0").withColumn("term", term)
    n = F.max("n")
    wide = terms.groupBy(*keys).agg(
        n.alias("n"), *[(n * (n + 2) * F.sum(F.when(F.col("k") <= m, F.col("term")))).alias(f"q{m}") for m in lags]
    )
    pairs = ", ".join(f"{m}, q{m}" for m in lags)
    tested = wide.selectExpr(*keys, "n", f"stack({len(lags)}, {pairs}) AS (lag, q_stat)").where("n > lag")
    return tested.withColumn("p_value", S.chi2_sf(F.col("q_stat"), F.col("lag")))


def fixed_histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins on [low, high]; the top edge belongs to the last bin."""
    inside = df.where(F.col(value).between(low, high))
    bin_no = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return inside.groupBy(*keys, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def spanning_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in equal bins between the smallest and the largest value."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    edges = F.struct(*[span.select(c).scalar().alias(c) for c in ("lo", "hi")])
    placed = df.where(F.col(value).isNotNull()).withColumn("_e", edges)
    width = (F.col("_e.hi") - F.col("_e.lo")) / bins
    place = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_e.lo"), width)), F.lit(0))
    bin_no = F.least(place, F.lit(bins - 1)).cast("int")
    return placed.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


__all__ = [
    "empirical_cdf", "fixed_histogram", "ks_statistic", "ks_test", "ljung_box", "normality", "normality_moments",
    "normality_ranks", "quantile_pairs", "shifted_correlation", "spanning_histogram", "value_histogram",
]

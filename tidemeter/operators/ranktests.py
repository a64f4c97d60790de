"""Rank tests and pointwise variance analysis for all stations at once.

Samples enter as histograms (station, label, value, n), so ties are handled by weights and the ranking
is a running total over value ranges rather than a sort of one station in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.functions import special as S
from tidemeter.operators.curves import points
from tidemeter.operators.split import rank_ranges, running_total, value_histogram
from tidemeter.session import stored


def average_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values of each key with count, last rank and tie-averaged rank."""
    return rank_ranges(df, keys, value).withColumn("avg_rank", F.col("upto") - (F.col("n") - 1) / 2)


def _rank_sums(df: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """Size and rank sum per label, and its part of the tie term (which stands with the first label of each value).

    The histogram is made once; a distinct value is one row with its few labels, so one sort ranks all labels.
    """
    labels = value_histogram(df, keys, [label], value).groupBy(*keys, value)
    hist = labels.agg(F.sum("n").alias("all"), F.collect_list(F.struct(F.col(label), "n")).alias("labels"))
    ranked = running_total(stored(hist, "ranks"), keys, [value], {"upto": "all"})
    ranked = ranked.withColumn("avg_rank", F.col("upto") - (F.col("all") - 1) / 2)
    rows = ranked.select(*keys, "all", "avg_rank", F.posexplode("labels").alias("i", "l")).select(*keys, "all", "avg_rank", "i", "l.*")
    every = F.col("all").cast("double")
    return rows.groupBy(*keys, label).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("avg_rank")).alias("rank_sum"),
        F.sum(F.when(F.col("i") == 0, every * every * every - every)).alias("ties"),
    )


def kruskal(df: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction and chi-square p-value; keys with one label are left out."""
    sums = _rank_sums(df.where(F.col(label).isNotNull()), keys, label, value)
    grouped = sums.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("n").alias("n"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("ss"),
        F.sum("ties").alias("ties"),
    )
    n = F.col("n").cast("double")
    raw = F.lit(12.0) / (n * (n + 1)) * F.col("ss") - 3 * (n + 1)
    correction = 1 - F.col("ties") / (n * n * n - n)
    h = F.when(correction > 0, raw / correction)
    out = grouped.where("n_groups > 1").withColumn("h_stat", h)
    return out.withColumn("p_value", S.chi2_sf(F.col("h_stat"), F.col("n_groups") - 1)).select(
        *keys, "n_groups", "n", "h_stat", "p_value"
    )


def weekday_consistency(facts: DataFrame, value: str) -> DataFrame:
    """Differences among Monday to Friday on ordinary working days."""
    return kruskal(facts.where("date_type = 'WD' AND day_of_week BETWEEN 0 AND 4"), ["station"], "day_of_week", value)


def date_type_differences(facts: DataFrame, value: str) -> DataFrame:
    return kruskal(facts, ["station"], "date_type", value)


def monthly_stability(facts: DataFrame, value: str) -> DataFrame:
    return kruskal(facts, ["station"], "month", value)


def mann_whitney(df: DataFrame, keys: list[str], label: str, first, second, value: str) -> DataFrame:
    """U of the first sample and the two-sided normal p-value with tie and continuity correction."""
    two = df.where(F.col(label).isin(first, second))
    sums = _rank_sums(two, keys, label, value)

    def of(which, column):
        return F.coalesce(F.sum(F.when(F.col(label) == which, F.col(column))), F.lit(0))

    wide = sums.groupBy(*keys).agg(
        of(first, "n").alias("n1"), of(second, "n").alias("n2"), of(first, "rank_sum").alias("r1"),
        F.sum("ties").alias("ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (F.greatest(F.col("u_stat"), n1 * n2 - F.col("u_stat")) - n1 * n2 / 2 - 0.5) / F.col("_sd")
    return (
        wide.where("n1 > 0 AND n2 > 0")
        .withColumn("u_stat", u)
        .withColumn("_sd", sd)
        .withColumn("p_value", F.when(F.col("_sd") > 0, F.least(F.lit(1.0), 2 * S.normal_sf(z))).otherwise(F.lit(1.0)))
        .select(*keys, "n1", "n2", "u_stat", "p_value")
    )


def sunday_versus_holiday(facts: DataFrame, value: str) -> DataFrame:
    return mann_whitney(facts, ["station"], "date_type", "SU", "HO", value)


def pointwise_anova(aligned: DataFrame, label: str) -> DataFrame:
    """One-way F at every curve position; labels with a single day and flat positions are left out."""
    sized = points(aligned, ["station", label]).groupBy("station", "pos", label).agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var")
    )
    kept = sized.where("n > 1")
    n, mean = F.col("n"), F.col("mean")
    per_pos = kept.groupBy("station", "pos").agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("total"),
        (F.sum(n * mean * mean) - F.sum(n * mean) * F.sum(n * mean) / F.sum(n)).alias("between"),
        F.sum(n * F.col("var")).alias("within"),
        F.max(F.sqrt("var")).alias("spread"),
    )
    df1, df2 = F.col("groups") - 1, F.col("total") - F.col("groups")
    f = (F.col("between") / df1) / (F.col("within") / df2)
    return (
        per_pos.where("groups > 1")
        .withColumn("f_stat", F.when(F.col("spread") > 1e-8, f))
        .withColumn("df1", df1.cast("double"))
        .withColumn("df2", df2.cast("double"))
        .select("station", "pos", "groups", "f_stat", "df1", "df2")
    )


def functional_anova(aligned: DataFrame, label: str, fixed: tuple[str, object] | None = None) -> DataFrame:
    """Mean p-value and share of significant positions per station, optionally with one factor held fixed."""
    if fixed:
        aligned = aligned.where(F.col(fixed[0]) == fixed[1])
    tested = pointwise_anova(aligned, label).withColumn("p", S.f_sf("f_stat", "df1", "df2"))
    return tested.groupBy("station").agg(
        F.max("groups").alias("n_groups"),
        F.avg("p").alias("mean_p"),
        F.avg(F.when(F.col("p") < 0.05, 1.0).otherwise(0.0)).alias("frac_significant"),
    )

"""Intensity, dispersion, self-excitation and clustering model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemeter.functions import columns as C
from tidemeter.operators import cluster, curves, dispersion, families, hawkes, intensity, process, rates, smoothing
from tidemeter.plans import oracle as O
from tidemeter.plans.flow import ACCURACY_SQL, BIN, HOLDOUT_SQL, LENGTH, POINTS, aligned_curves
from tidemeter.plans.registry import day, query, rounded
from tidemeter.plans.scalars import _family_sql, _parameter_sql
from tidemeter.session import stored
from tidemeter.sources import tables


@query(
    "m1_kernel_intensity",
    f"""WITH {O.minute_grid()} SELECT station, {O.day('d')} AS date, CAST(minute AS INT) AS minute, n, round(lam, 6) AS intensity FROM grid""",
)
def kernel_intensity(spark: SparkSession, sf: str) -> DataFrame:
    grid = intensity.kernel_intensity(tables.taps(spark, sf))
    return rounded(grid.select("station", day("date").alias("date"), "minute", "n", "intensity"))


@query(
    "m2_compensator_increments",
    f"""WITH {O.minute_grid()}, c AS (SELECT *, sum(lam) OVER (PARTITION BY station, d ORDER BY minute) AS comp FROM grid),
e AS (SELECT t.station, c.d, c.minute, comp - lag(comp) OVER (PARTITION BY t.station, c.d ORDER BY t.ts, t.event_id) AS delta FROM taps t
 JOIN c ON c.station = t.station AND c.d = CAST(t.ts AS DATE) AND c.minute = hour(t.ts) * 60 + minute(t.ts) WHERE {O.OPEN})
SELECT station, {O.day('d')} AS date, CAST(minute AS INT) AS minute, round(delta, 6) AS delta, round(1 - exp(-delta), 6) AS pit, count(*) AS weight
FROM e WHERE delta IS NOT NULL GROUP BY ALL""",
)
def compensator_increments(spark: SparkSession, sf: str) -> DataFrame:
    steps = intensity.compensator_increments(intensity.kernel_intensity(tables.taps(spark, sf)))
    return rounded(steps.select("station", day("date").alias("date"), "minute", "delta", "pit", "weight"))


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return stored(rates.count_facts(tables.taps(spark, sf), BIN), "facts")


@query("m3_smoothed_intensity")
def smoothed_intensity(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothed hourly intensity and its integral; the budget suits intensities well below one per minute."""
    fitted = smoothing.intensity_then_mvf(_facts(spark, sf), "count_in", budget=0.01, minutes=BIN)
    return rounded(fitted.select("station", "date_type", "i", "t", "intensity", "m", "sse"))


@query("m4_smoothed_mvf")
def smoothed_mvf(spark: SparkSession, sf: str) -> DataFrame:
    fitted = smoothing.mvf_then_intensity(_facts(spark, sf), "count_in", budget=10.0)
    return rounded(fitted.select("station", "date_type", "i", "t", "m", "intensity", "sse"))


@query("m5_smooth_model_accuracy")
def smooth_model_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(smoothing.evaluate_smooth_intensity(_facts(spark, sf), "count_in", budget=0.01, minutes=BIN))


@query("m6_average_model_accuracy", f"WITH {O.count_facts(60)}, {HOLDOUT_SQL} {ACCURACY_SQL}")
def average_model_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.evaluate_average_curve(_facts(spark, sf), "count_in", BIN))


#: log(1 + x) by its series where x is small, as DuckDB has no log1p.
LOG1P = "(CASE WHEN abs({0}) < 1e-3 THEN {0} - pow({0}, 2) / 2 + pow({0}, 3) / 3 - pow({0}, 4) / 4 + pow({0}, 5) / 5 ELSE ln(1 + {0}) END)"


def _dispersion_sql(halvings: int = dispersion.HALVINGS) -> str:
    """CTEs ending in fitted(station, d, k, loglik): the score's crossing by written-out halvings of log k from 1e-8 to 1e3."""
    km = LOG1P.format("(k * m)")
    parts = [f"""{O.minute_grid()}, nm AS MATERIALIZED (SELECT station, d, n, greatest(lam, 1e-6) AS m FROM grid),
h_0 AS MATERIALIZED (SELECT station, d, ln(1e-8) AS low, ln(1e3) AS high FROM nm GROUP BY ALL)"""]
    for r in range(1, halvings + 1):
        parts.append(f"""h_{r} AS MATERIALIZED (
  SELECT station, d, CASE WHEN score > 0 THEN (low + high) / 2 ELSE low END AS low, CASE WHEN score > 0 THEN high ELSE (low + high) / 2 END AS high FROM (
    SELECT station, d, low, high, sum({km} - k * (m - n) / (1 + k * m) - coalesce(list_sum(list_transform(range(n), lambda j: k / (1 + k * j))), 0)) AS score
    FROM (SELECT *, exp((low + high) / 2) AS k FROM nm JOIN h_{r - 1} USING (station, d)) GROUP BY ALL))""")
    gammas = "coalesce(list_sum(list_transform(range(n), lambda j: " + LOG1P.format("(k * j)") + ")), 0)"
    parts.append(f"""fitted AS (SELECT station, d, k, sum({gammas} + n * ln(m) - lgamma(n + 1) - (n + 1 / k) * {km}) AS loglik
  FROM (SELECT station, d, n, m, exp(low) AS k FROM nm JOIN h_{halvings} USING (station, d)) GROUP BY ALL)""")
    return ",\n".join(parts)


@query(
    "m7_nb_dispersion",
    f"""WITH {_dispersion_sql()} SELECT station, {O.day('d')} AS date, round(k, 4) AS k, round(loglik, 4) AS loglik FROM fitted""",
)
def nb_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    fitted = dispersion.fit_k(intensity.kernel_intensity(tables.taps(spark, sf)))
    return rounded(fitted.select("station", day("date").alias("date"), "k", "loglik"), 4)


@query(
    "m8_randomised_pit",
    f"""WITH {O.minute_grid()},
mk AS (SELECT station, d, 1 / greatest((var_samp(n) - avg(n)) / (avg(n) * avg(n)), 1e-8) AS r FROM grid GROUP BY ALL),
rq AS (SELECT station, d, minute, n, r, greatest(lam, 1e-6) AS mu, greatest(lam, 1e-6) / (greatest(lam, 1e-6) + r) AS q FROM grid JOIN mk USING (station, d)),
pr AS (SELECT *, list_transform(range(n + 1), lambda i: exp(-r * {LOG1P.format('(mu / r)')}) * coalesce(list_product(list_transform(range(1, i + 1), lambda j: (j - 1 + r) / j * q)), 1)) AS p FROM rq)
SELECT station, {O.day('d')} AS date, CAST(minute AS INT) AS minute, n,
 round(least(1e0, coalesce(list_sum(p[1:n]), 0) + {O.unit_hash(42, 'station', 'd', 'minute')} * p[n + 1]), 6) AS u FROM pr""",
)
def randomised_pit(spark: SparkSession, sf: str) -> DataFrame:
    """Residuals with the moment estimate of k, whose value does not depend on an optimiser."""
    grid = intensity.kernel_intensity(tables.taps(spark, sf))
    residuals = dispersion.randomised_pit(grid, intensity.moment_k(grid))
    return rounded(residuals.select("station", day("date").alias("date"), "minute", "n", "u"))


def _fit_sql(rounds: int = hawkes.ROUNDS) -> str:
    """CTEs ending in fitted(station, d, alpha, beta, loglik): decayed sums over all pairs of seconds of a day, a grid of 13 by
    13, then grids of five by five with half the step around the best cell in every written-out round. Bounds are 1e-8 and 1e3 on both axes."""
    day = "PARTITION BY station, d ORDER BY minute"
    parts = [f"""{O.minute_grid()},
area AS (SELECT *, coalesce((lam + lag(lam) OVER ({day})) / 2, 0) AS area FROM grid),
run AS (SELECT *, sum(area) OVER ({day}) AS a FROM area),
edge AS (SELECT *, coalesce(lead(lam) OVER ({day}), lam) AS y1, coalesce(lead(a) OVER ({day}), a) AS a1, max(a) OVER (PARTITION BY station, d) AS mass FROM run),
es AS (SELECT station, CAST(ts AS DATE) AS d, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS sec, count(*) AS n FROM taps WHERE {O.OPEN} GROUP BY ALL),
ev AS MATERIALIZED (SELECT es.station, es.d, sec, sec / 60e0 AS t, es.n, lam + (y1 - lam) * (sec / 60e0 - minute) AS mu, a + (a1 - a) * (sec / 60e0 - minute) AS base, mass
  FROM es JOIN edge e ON e.station = es.station AND e.d = es.d AND e.minute = sec // 60),
dy AS MATERIALIZED (SELECT station, d, max(mass) AS mass, greatest(1380e0, max(t)) AS fin, sum(n) AS events FROM ev GROUP BY ALL),
box_0 AS MATERIALIZED (SELECT station, d, ln(1e-8) AS b, ln(1e-8) AS a, (ln(1e3) - ln(1e-8)) / 12 AS w, 0e0 AS beta, 0e0 AS alpha, 0e0 AS loglik FROM dy)"""]
    placed = "least(greatest({0} + {1} * w - w, ln(1e-8)), ln(1e3) - 2 * w)"
    for r in range(1, rounds + 2):
        cells = f"(SELECT unnest(range({13 if r == 1 else 5})) AS i)"
        parts.append(f"""c_{r} AS MATERIALIZED (SELECT station, d, i, exp(b + i * w) AS beta FROM box_{r - 1}, {cells}),
s_{r} AS MATERIALIZED (SELECT e.station, e.d, e.sec, c.i, e.n, e.mu, coalesce(sum(p.n * exp(-c.beta * (e.t - p.t))), 0) AS s
  FROM ev e JOIN c_{r} c ON c.station = e.station AND c.d = e.d LEFT JOIN ev p ON p.station = e.station AND p.d = e.d AND p.sec < e.sec
  GROUP BY e.station, e.d, e.sec, c.i, e.n, e.mu),
x_{r} AS MATERIALIZED (SELECT station, d, i, sum(n * (1 - exp(-beta * (fin - t))) / beta) AS x FROM ev JOIN c_{r} USING (station, d) JOIN dy USING (station, d) GROUP BY ALL),
l_{r} AS MATERIALIZED (SELECT s.station, s.d, s.i, j.i AS j, sum(ln(greatest(s.mu + exp(a + j.i * w) * (s.s + q), 1e-300))) AS v
  FROM (SELECT *, unnest(range(n)) AS q FROM s_{r}) s JOIN box_{r - 1} USING (station, d), {cells} j GROUP BY ALL),
v_{r} AS (SELECT l.station, l.d, l.i, j, round(v - mass - exp(a + j * w) * x, 6) AS v, b, a, w FROM l_{r} l JOIN x_{r} USING (station, d, i) JOIN box_{r - 1} USING (station, d) JOIN dy USING (station, d)),
box_{r} AS MATERIALIZED (SELECT station, d, {placed.format("b", "i")} AS b, {placed.format("a", "j")} AS a, w / 2 AS w, exp(b + i * w) AS beta, exp(a + j * w) AS alpha, v AS loglik
  FROM v_{r} QUALIFY row_number() OVER (PARTITION BY station, d ORDER BY v DESC, i, j) = 1)""")
    return ",\n".join(parts) + f",\nfitted AS (SELECT station, d, alpha, CASE WHEN alpha < 2e-8 THEN 1e3 ELSE beta END AS beta, loglik FROM box_{rounds + 1})"


@query(
    "m9_self_exciting_fit",
    f"""WITH {_fit_sql()} SELECT station, {O.day('d')} AS date, round(alpha, 4) AS alpha, round(beta, 4) AS beta, round(alpha / beta, 4) AS branching,
 round(loglik, 4) AS loglik, CAST(events AS BIGINT) AS events FROM fitted JOIN dy USING (station, d)""",
)
def self_exciting_fit(spark: SparkSession, sf: str) -> DataFrame:
    fitted = hawkes.parameters(hawkes.fit(tables.taps(spark, sf)))
    return rounded(fitted.select("station", day("date").alias("date"), "alpha", "beta", "branching", "loglik", "events"), 4)


@query("m10_self_exciting_diagnostics")
def self_exciting_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    tested = hawkes.diagnostics(hawkes.fit(tables.taps(spark, sf)))
    return rounded(tested.withColumn("date", day("date")), 4)


@query(
    "m10_residual_autocorrelation",
    f"""WITH {_fit_sql()},
lv AS (SELECT e.station, e.d, e.sec, e.base + any_value(alpha / beta) * coalesce(sum(p.n * (1 - exp(-beta * (e.t - p.t)))), 0) AS level
  FROM ev e JOIN fitted f ON f.station = e.station AND f.d = e.d LEFT JOIN ev p ON p.station = e.station AND p.d = e.d AND p.sec < e.sec GROUP BY e.station, e.d, e.sec, e.base),
ta AS (SELECT *, level - lag(level) OVER (PARTITION BY station, d ORDER BY sec) AS tau FROM lv),
pt AS (SELECT station, d, 1 - exp(-tau) AS x, row_number() OVER (PARTITION BY station, d ORDER BY sec) AS i FROM ta WHERE tau > 0)
SELECT a.station, {O.day('a.d')} AS date, CAST(l AS INT) AS lag, CASE WHEN var_pop(a.x) > 0 AND var_pop(z.x) > 0 THEN round(corr(a.x, z.x), 4) + 0e0 END AS acf
FROM pt a, (SELECT unnest(range(1, 40)) AS l) JOIN pt z ON z.station = a.station AND z.d = a.d AND z.i = a.i - l GROUP BY ALL""",
)
def residual_autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    acf = hawkes.residual_autocorrelation(hawkes.fit(tables.taps(spark, sf)))
    return rounded(acf.withColumn("date", day("date")), 4)


@query(
    "m11_poisson_versus_nb",
    f"""WITH {O.TAPS}, c AS (SELECT station, {O.bucket(15)} AS w, count(*) AS n FROM taps GROUP BY ALL),
m AS (SELECT station, hour(w) AS h, n, avg(n) OVER (PARTITION BY station, hour(w)) AS mu FROM c)
SELECT station, count(*) AS windows, round(2 * count(DISTINCT h) - 2 * sum(n * ln(mu) - mu - lgamma(n + 1)), 4) AS poisson_aic,
 round(2 * count(DISTINCT h) - 2 * sum(n * ln(mu / (1 + mu)) - ln(1 + mu)), 4) AS nb_aic, round(sum(pow(n - mu, 2) / mu), 4) AS poisson_chi2,
 round(sum(pow(n - mu, 2) / (mu + mu * mu)), 4) AS nb_chi2, round(var_samp(n) / avg(n), 4) AS vmr FROM m GROUP BY station""",
)
def poisson_versus_nb(spark: SparkSession, sf: str) -> DataFrame:
    counts = rates.window_counts(tables.taps(spark, sf), 15).withColumn("hour", F.hour("w"))
    return rounded(process.poisson_versus_nb(counts, ["station"]), 4)


@query(
    "m11_intercept_only",
    f"""WITH {O.TAPS}, c AS (SELECT station, {O.bucket(15)} AS w, count(*) AS n FROM taps GROUP BY ALL),
m AS (SELECT station, n, avg(n) OVER (PARTITION BY station) AS mu FROM c)
SELECT station, count(*) AS windows, round(2 - 2 * sum(n * ln(mu) - mu - lgamma(n + 1)), 4) AS poisson_aic,
 round(2 - 2 * sum(n * ln(mu / (1 + mu)) - ln(1 + mu)), 4) AS nb_aic, round(sum(pow(n - mu, 2) / mu), 4) AS poisson_chi2,
 round(sum(pow(n - mu, 2) / (mu + mu * mu)), 4) AS nb_chi2, round(var_samp(n) / avg(n), 4) AS vmr FROM m GROUP BY station""",
)
def intercept_only(spark: SparkSession, sf: str) -> DataFrame:
    """The pair of models with one mean for all windows of a station."""
    return rounded(process.poisson_versus_nb(rates.window_counts(tables.taps(spark, sf), 15), ["station"], None), 4)


def fine_signatures(spark: SparkSession, sf: str, measure: str = "lambda_in") -> DataFrame:
    """Signatures of twenty finer stations (event type and card group); five are too few to cluster."""
    daily = curves.daily_curves(rates.rate_facts(_fine_taps(spark, sf), BIN), measure, min_points=5)
    return curves.signatures(curves.aligned_curves(daily, LENGTH, 5))


def _fine_taps(spark: SparkSession, sf: str) -> DataFrame:
    return tables.taps(spark, sf).withColumn("station", F.concat_ws("-", "station", F.col("card") % 4))


K_BY_TYPE = {"WD": 3, "SA": 2, "SU": 4, "HO": 5}


def _kmeans_sql(curves_sql: str, k_by_type: dict[str, int], rounds: int = 16, seed: int = 42) -> str:
    """K-means to its fixed point: standardised signatures, farthest-first start, written-out rounds; ``curves_sql`` ends in cp."""
    fine = curves_sql.replace("event_type AS station,", "event_type || '-' || (user_id % 4) AS station,")
    parts = [f"""{fine},
sg AS (SELECT station, date_type, pos, avg(v) AS v FROM cp GROUP BY ALL),
ms AS (SELECT date_type, pos, avg(v) AS m, stddev_pop(v) AS s FROM sg GROUP BY ALL),
st AS MATERIALIZED (SELECT station, date_type, pos, CASE WHEN s > 1e-12 THEN (v - m) / s ELSE 0 END AS z FROM sg JOIN ms USING (date_type, pos)),
kk(date_type, k) AS (VALUES {", ".join(f"('{t}', {k})" for t, k in k_by_type.items())}),
able AS (SELECT date_type, k FROM st JOIN kk USING (date_type) GROUP BY ALL HAVING count(DISTINCT station) >= k),
chosen_0 AS MATERIALIZED (SELECT date_type, 0 AS c, arg_min(station, md5('{seed}:' || station)) AS station FROM st SEMI JOIN able USING (date_type) GROUP BY date_type)"""]
    for i in range(1, max(k_by_type.values())):
        parts.append(f"""gap_{i} AS (SELECT date_type, station, min(d) AS gap FROM (
  SELECT s.date_type, s.station, c.c, round(sum(pow(s.z - x.z, 2)), 10) AS d FROM st s JOIN chosen_{i - 1} c USING (date_type)
  JOIN st x ON x.date_type = s.date_type AND x.station = c.station AND x.pos = s.pos GROUP BY ALL) GROUP BY ALL),
chosen_{i} AS MATERIALIZED (SELECT * FROM chosen_{i - 1} UNION ALL (SELECT date_type, {i}, station FROM gap_{i} JOIN able USING (date_type)
  WHERE k > {i} QUALIFY row_number() OVER (PARTITION BY date_type ORDER BY gap DESC, station) = 1))""")
    last = max(k_by_type.values()) - 1
    parts.append(f"cen_0 AS MATERIALIZED (SELECT date_type, c, pos, z FROM chosen_{last} JOIN st USING (date_type, station))")
    for r in range(1, rounds + 1):
        parts.append(f"""lab_{r} AS MATERIALIZED (SELECT date_type, station, c FROM (
  SELECT s.date_type, s.station, n.c, round(sum(pow(s.z - n.z, 2)), 10) AS d FROM st s JOIN cen_{r - 1} n USING (date_type, pos) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY date_type, station ORDER BY d, c) = 1),
cen_{r} AS MATERIALIZED (SELECT o.date_type, o.c, o.pos, coalesce(round(m.z, 10), o.z) AS z FROM cen_{r - 1} o
  LEFT JOIN (SELECT date_type, c, pos, avg(z) AS z FROM st JOIN lab_{r} USING (date_type, station) GROUP BY ALL) m USING (date_type, c, pos))""")
    return "WITH " + ",\n".join(parts) + f"\nSELECT station, date_type, CAST(c AS INT) AS cluster FROM lab_{rounds}"


@query("m12_kmeans_by_type", _kmeans_sql(O.curves(60, 5, 20), K_BY_TYPE))
def kmeans_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.kmeans_by_type(fine_signatures(spark, sf), K_BY_TYPE)


@query("m12_kmeans_out", _kmeans_sql(O.curves(60, 5, 20, measure="lambda_out"), dict.fromkeys(K_BY_TYPE, 2)))
def kmeans_out(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures of the way out, two clusters for every day type."""
    return cluster.kmeans_by_type(fine_signatures(spark, sf, "lambda_out"), dict.fromkeys(K_BY_TYPE, 2))


@query("m12_kmeans_time_range", _kmeans_sql(O.curves(60, 4, 9, start=600, end=1400), dict.fromkeys(K_BY_TYPE, 2)))
def kmeans_time_range(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures of 06:00 to 14:00 from days with at least half of its hours, two clusters."""
    facts = rates.rate_facts(_fine_taps(spark, sf), BIN)
    return cluster.kmeans_by_type(curves.range_signatures(facts, "lambda_in", 600, 1400, BIN, 0.5), dict.fromkeys(K_BY_TYPE, 2))


@query("m13_mixture_by_type")
def mixture_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.mixture_by_type(fine_signatures(spark, sf), {"WD": 2, "SA": 2, "SU": 2, "HO": 2})


@query("m14_correlation_hierarchy")
def correlation_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """All day types; checked against plain average linkage in the tests."""
    return cluster.hierarchy(fine_signatures(spark, sf), 4)


@query("m14_embedding_hierarchy")
def embedding_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """The same on the feature vectors."""
    return cluster.hierarchy(embedding_signatures(spark, sf), 4)


def embedding_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("station"), F.lit("WD").alias("date_type"),
        F.col("embedding").cast("array<double>").alias("curve"),
    )


@query("m15_projection")
def projection(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cluster.projection(fine_signatures(spark, sf)), 4)


@query("m16_stability")
def stability(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cluster.stability(fine_signatures(spark, sf)), 4)


@query(
    "p23_best_family",
    f"""WITH {O.dense(60)},
cum AS (SELECT station, date_type, time, sum(count_in) OVER (PARTITION BY station, date_type, date ORDER BY time) AS c FROM dense),
mvf AS (SELECT station, date_type, (time // 100 * 60 + 60) / 144e0 AS t, avg(c) AS m FROM cum GROUP BY ALL),
params(family, p1, p2, p3, p4) AS (VALUES {_parameter_sql()}),
scored AS (SELECT station, date_type, family, p1, m, {_family_sql()} AS model FROM mvf, params),
sse AS (SELECT station, date_type, family, p1, sum((m - model) * (m - model)) AS sse FROM scored GROUP BY ALL)
SELECT station, date_type, family, p1, round(sse, 4) AS sse FROM sse QUALIFY row_number() OVER (PARTITION BY station, date_type ORDER BY sse, family, p1) = 1""",
)
def best_family(spark: SparkSession, sf: str) -> DataFrame:
    facts = _facts(spark, sf).where(C.in_hours("time"))
    observed = curves.mean_value_function(curves.dense_slots(facts, ["count_in"]), "count_in")
    timed = observed.withColumn("t", (C.hhmm_to_minutes("time") + 60) / 144.0)
    best = families.best_family(timed, ["station", "date_type"])
    return rounded(best.select("station", "date_type", "family", "p1", "sse"), 4)


__all__ = ["POINTS", "aligned_curves"]

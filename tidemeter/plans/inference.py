"""Statistical-test queries for all stations at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemeter.operators import goodness, intensity, process, ranktests, rates
from tidemeter.operators.intensity import DAY
from tidemeter.plans import oracle as O
from tidemeter.plans.flow import _five_minute_series, aligned_curves
from tidemeter.plans.registry import day, query, rounded
from tidemeter.sources import tables


def _rates(spark: SparkSession, sf: str) -> DataFrame:
    return rates.rate_facts(tables.taps(spark, sf), 15)


def _kruskal_sql(ctes: str, source: str, label: str, value: str) -> str:
    return f"""WITH {ctes}
s AS (SELECT station, {label} AS label, {value} AS v FROM {source}),
r AS (SELECT *, rank() OVER (PARTITION BY station ORDER BY v) + (count(*) OVER (PARTITION BY station, v) - 1) / 2e0 AS rk,
             count(*) OVER (PARTITION BY station, v) AS t, count(*) OVER (PARTITION BY station) AS n FROM s),
g AS (SELECT station, label, max(n) AS n, count(*) AS m, sum(rk) AS rs FROM r GROUP BY ALL),
tie AS (SELECT station, sum((CAST(t AS DOUBLE) * t * t - t) / t) AS ties FROM r GROUP BY station)
SELECT g.station, count(*) AS n_groups, CAST(max(n) AS BIGINT) AS n,
 round((12e0 / (max(n) * (max(n) + 1e0)) * sum(rs * rs / m) - 3 * (max(n) + 1)) / (1 - max(ties) / (CAST(max(n) AS DOUBLE) * max(n) * max(n) - max(n))), 6) AS h_stat
FROM g JOIN tie ON tie.station = g.station GROUP BY g.station HAVING count(*) > 1"""


def _h_only(df: DataFrame) -> DataFrame:
    return rounded(df.select("station", "n_groups", "n", "h_stat"))


@query(
    "t1_weekday_consistency",
    _kruskal_sql(f"{O.rate_facts(15)}, wd AS (SELECT * FROM rates WHERE date_type = 'WD' AND day_of_week BETWEEN 0 AND 4),", "wd", "day_of_week", "lambda_in"),
)
def weekday_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return _h_only(ranktests.weekday_consistency(_rates(spark, sf), "lambda_in"))


@query("t2_date_type_differences", _kruskal_sql(f"{O.rate_facts(15)},", "rates", "date_type", "lambda_out"))
def date_type_differences(spark: SparkSession, sf: str) -> DataFrame:
    return _h_only(ranktests.date_type_differences(_rates(spark, sf), "lambda_out"))


ORDERS_SQL = "o AS (SELECT o_orderpriority AS station, month(o_orderdate) AS month, o_totalprice AS value FROM orders),"


@query("t3_monthly_stability", _kruskal_sql(ORDERS_SQL, "o", "month", "value"))
def monthly_stability(spark: SparkSession, sf: str) -> DataFrame:
    return _h_only(ranktests.monthly_stability(tables.order_values(spark, sf), "value"))


@query(
    "t3_monthly_stability_p_values",
    f"""WITH h AS ({_kruskal_sql(ORDERS_SQL, 'o', 'month', 'value').replace(", 6) AS h_stat", ", 12) AS h_stat")})
SELECT station, n_groups, n, round(h_stat, 6) AS h_stat,
 round({O.erfc('sqrt(h_stat / 2)')} + exp(-h_stat / 2) * list_sum(list_transform(range(1, (n_groups - 2) // 2 + 1),
   lambda i: exp((i - 0.5e0) * ln(h_stat / 2) - lgamma(i + 0.5e0)))), 6) AS p_value FROM h""",
)
def monthly_stability_p_values(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranktests.monthly_stability(tables.order_values(spark, sf), "value"))


@query(
    "t4_sunday_versus_holiday",
    f"""WITH {O.rate_facts(15)}, s AS (SELECT station, date_type, lambda_in AS v FROM rates WHERE date_type IN ('SU', 'HO')),
r AS (SELECT *, rank() OVER (PARTITION BY station ORDER BY v) + (count(*) OVER (PARTITION BY station, v) - 1) / 2e0 AS rk,
             count(*) OVER (PARTITION BY station, v) AS t FROM s),
a AS (SELECT station, count(*) FILTER (date_type = 'SU') AS n1, count(*) FILTER (date_type = 'HO') AS n2, sum(rk) FILTER (date_type = 'SU') AS r1,
             sum(CAST(t AS DOUBLE) * t - 1) AS ties, count(*) AS n FROM r GROUP BY station),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2e0 AS u, sqrt(n1 * n2 / 12e0 * (n + 1 - ties / (n * (n - 1e0)))) AS sd FROM a),
z AS (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2e0 - 0.5e0) / sd AS z FROM u)
SELECT station, n1, n2, round(u, 6) AS u_stat, round(least(1e0, {O.erfc('(z * sqrt(0.5e0))')}), 6) AS p_value FROM z""",
)
def sunday_versus_holiday(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranktests.sunday_versus_holiday(_rates(spark, sf), "lambda_in"))


@query(
    "t5_normality_moments",
    f"""WITH {O.rate_facts(15)}, c AS (SELECT station, date_type, lambda_out AS x FROM rates WHERE lambda_out IS NOT NULL),
m AS (SELECT c.station, c.date_type, x - avg(x) OVER (PARTITION BY c.station, c.date_type) AS e FROM c),
g AS (SELECT station, date_type, CAST(count(*) AS DOUBLE) AS n, avg(e*e*e) / pow(avg(e*e), 1.5) AS g1, avg(e*e*e*e) / pow(avg(e*e), 2) AS b2 FROM m GROUP BY ALL),
s AS (SELECT *, g1 * sqrt((n+1)*(n+3)/(6*(n-2))) AS y, 3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) AS be FROM g),
w AS (SELECT *, -1 + sqrt(2*(be-1)) AS w2 FROM s),
q AS (SELECT *, 1/sqrt(0.5*ln(w2)) AS delta, y / sqrt(2/(w2-1)) AS ya,
  (b2 - 3*(n-1)/(n+1)) / sqrt(24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) AS x,
  6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS rb FROM w),
k AS (SELECT *, 6 + 8/rb*(2/rb + sqrt(1+4/(rb*rb))) AS a FROM q),
z AS (SELECT *, delta * ln(ya + sqrt(ya*ya+1)) AS zs, 1 + x*sqrt(2/(a-4)) AS den FROM k),
f AS (SELECT *, ((1-2/(9*a)) - sign(den)*pow((1-2/a)/abs(den), 1/3e0)) / sqrt(2/(9*a)) AS zk FROM z)
SELECT station, date_type, CAST(n AS BIGINT) AS n, round(zs*zs + zk*zk, 6) AS k2, round(exp(-(zs*zs + zk*zk)/2), 6) AS k2_p FROM f WHERE n >= 8""",
)
def normality_moments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(goodness.normality_moments(_rates(spark, sf), ["station", "date_type"], "lambda_out"))


NORMAL_SQL = f"""{O.rate_facts(15)}, c AS (SELECT station, lambda_out AS x FROM rates WHERE lambda_out IS NOT NULL),
r AS (SELECT *, row_number() OVER p AS i, count(*) OVER q AS n, (x - avg(x) OVER q) / stddev_samp(x) OVER q AS z, var_pop(x) OVER q AS vp
      FROM c WINDOW p AS (PARTITION BY station ORDER BY x), q AS (PARTITION BY station)),
f AS (SELECT *, {O.normal_cdf('z')} AS lo, {O.normal_cdf('(-z)')} AS hi, {O.normal_ppf('((i - 0.375e0) / (n + 0.25e0))')} AS m FROM r),
g AS (SELECT station, max(n) AS n, sqrt(1e0 / max(n)) AS u, max(vp) AS vp,
  -max(n) - sum((2*i-1)/CAST(n AS DOUBLE) * ln(lo) + (2*(n-i)+1)/CAST(n AS DOUBLE) * ln(hi)) AS anderson,
  max(greatest(i/CAST(n AS DOUBLE) - lo, lo - (i-1)/CAST(n AS DOUBLE))) AS ks, sum(m*m) AS mm, max(m) AS m1, max(m) FILTER (i = n-1) AS m2,
  sum(m*x) FILTER (i > 2 AND i < n-1) AS body, max(x) FILTER (i = n) - max(x) FILTER (i = 1) AS span1, max(x) FILTER (i = n-1) - max(x) FILTER (i = 2) AS span2
  FROM f GROUP BY station),
a AS (SELECT *, m1/sqrt(mm) + 0.221157*u - 0.147981*u*u - 2.071190*u*u*u + 4.434685*u*u*u*u - 2.706056*u*u*u*u*u AS a1,
  m2/sqrt(mm) + 0.042981*u - 0.293762*u*u - 1.752461*u*u*u + 5.682633*u*u*u*u - 3.582633*u*u*u*u*u AS a2 FROM g)"""


@query(
    "t5_normality_ranks",
    f"""WITH {NORMAL_SQL}
SELECT station, CAST(n AS BIGINT) AS n, round(pow(body / sqrt((mm - 2*m1*m1 - 2*m2*m2) / (1 - 2*a1*a1 - 2*a2*a2)) + a1*span1 + a2*span2, 2) / (vp*n), 6) AS shapiro,
round(anderson, 6) AS anderson, round(ks, 6) AS ks FROM a""",
)
def normality_ranks(spark: SparkSession, sf: str) -> DataFrame:
    tested = goodness.normality_ranks(_rates(spark, sf), ["station"], "lambda_out")
    return rounded(tested.select("station", "n", "shapiro", "anderson", "ks"))


@query("t5_normality_battery")
def normality_battery(spark: SparkSession, sf: str) -> DataFrame:
    """All tests with p-values and flags, per station and weekday."""
    return rounded(goodness.normality(_rates(spark, sf), ["station", "day_of_week"], "lambda_out"))


@query(
    "t6_pointwise_anova",
    f"""WITH {O.curves(60, 10, 20)},
g AS (SELECT station, pos, date_type, count(*) AS n, avg(v) AS m, var_pop(v) AS vp FROM cp GROUP BY ALL HAVING count(*) > 1),
p AS (SELECT station, pos, count(*) AS k, sum(n) AS n, sum(n*m*m) - pow(sum(n*m), 2)/sum(n) AS b, sum(n*vp) AS w FROM g GROUP BY ALL)
SELECT station, CAST(pos AS INT) AS pos, k AS groups, round((b/(k-1)) / (w/(n-k)), 6) AS f_stat FROM p WHERE k > 1""",
)
def pointwise_anova(spark: SparkSession, sf: str) -> DataFrame:
    tested = ranktests.pointwise_anova(aligned_curves(spark, sf), "date_type")
    return rounded(tested.select("station", "pos", "groups", "f_stat"))


@query("t6_functional_anova")
def functional_anova(spark: SparkSession, sf: str) -> DataFrame:
    """Mean p and significant share among weekdays, holding the day type at working days."""
    return rounded(ranktests.functional_anova(aligned_curves(spark, sf), "day_of_week", ("date_type", "WD")))


KS_SQL = """SELECT {keys}, count(*) AS n, round(max(greatest(i / CAST(n AS DOUBLE) - f, f - (i - 1) / CAST(n AS DOUBLE))), 6) AS d_stat FROM {source} GROUP BY ALL"""


@query(
    "t7_ks_uniform",
    f"""WITH {O.minute_grid()}, c AS (SELECT *, sum(lam) OVER (PARTITION BY station, d ORDER BY minute) AS comp FROM grid),
e AS (SELECT t.station, c.d, 1 - exp(-(comp - lag(comp) OVER (PARTITION BY t.station, c.d ORDER BY t.ts, t.event_id))) AS f FROM taps t
 JOIN c ON c.station = t.station AND c.d = CAST(t.ts AS DATE) AND c.minute = hour(t.ts) * 60 + minute(t.ts) WHERE {O.OPEN}),
r AS (SELECT station, {O.day('d')} AS date, f, row_number() OVER (PARTITION BY station, d ORDER BY f) AS i, count(*) OVER (PARTITION BY station, d) AS n FROM e WHERE f IS NOT NULL)
{KS_SQL.format(keys='station, date', source='r')}""",
)
def ks_uniform(spark: SparkSession, sf: str) -> DataFrame:
    """Kernel-compensator PIT of every station-day against the uniform distribution."""
    steps = intensity.compensator_increments(intensity.kernel_intensity(tables.taps(spark, sf)))
    tested = goodness.ks_statistic(steps, DAY, "pit", "uniform", weight="weight")
    return rounded(tested.select("station", day("date").alias("date"), "n", "d_stat"))


@query(
    "t7_ks_exponential",
    f"""WITH {O.TAPS}, x AS (SELECT station, exits / 50e0 AS x FROM taps),
r AS (SELECT station, 1 - exp(-x) AS f, row_number() OVER (PARTITION BY station ORDER BY x) AS i, count(*) OVER (PARTITION BY station) AS n FROM x)
{KS_SQL.format(keys='station', source='r')}""",
)
def ks_exponential(spark: SparkSession, sf: str) -> DataFrame:
    """Exit amounts, scaled by 50, against the unit exponential: one large sample per station."""
    rows = tables.taps(spark, sf).withColumn("x", F.col("exits") / 50.0)
    return rounded(goodness.ks_statistic(rows, ["station"], "x", "expon"))


@query("t7_ks_p_values")
def ks_p_values(spark: SparkSession, sf: str) -> DataFrame:
    steps = intensity.compensator_increments(intensity.kernel_intensity(tables.taps(spark, sf)))
    tested = goodness.ks_test(steps, DAY, "pit", "uniform", weight="weight")
    return rounded(tested.select("station", day("date").alias("date"), "n", "d_stat", "p_value"))


@query(
    "t8_kernel_rescaling",
    f"""WITH {O.minute_grid()},
tz AS (SELECT *, coalesce((lam + lag(lam) OVER (PARTITION BY station, d ORDER BY minute)) / 2, 0) AS area FROM grid),
cu AS (SELECT station, d, minute, sum(area) OVER (PARTITION BY station, d ORDER BY minute) AS y FROM tz),
nx AS (SELECT *, coalesce(lead(y) OVER (PARTITION BY station, d ORDER BY minute), y) AS y1 FROM cu),
e AS (SELECT t.station, n.d, t.ts, t.event_id, y + (y1 - y) * (epoch_us(ts) - epoch_us(date_trunc('minute', ts))) / 6e7 AS lv FROM taps t
 JOIN nx n ON n.station = t.station AND n.d = CAST(t.ts AS DATE) AND n.minute = hour(ts) * 60 + minute(ts) WHERE {O.OPEN}),
g AS (SELECT station, d, lv - lag(lv) OVER (PARTITION BY station, d ORDER BY ts, event_id) AS tau FROM e),
r AS (SELECT station, {O.day('d')} AS date, CASE WHEN tau > 0 THEN 1 - exp(-tau) ELSE 0 END AS f, row_number() OVER (PARTITION BY station, d ORDER BY tau) AS i,
      count(*) OVER (PARTITION BY station, d) AS n FROM g WHERE tau IS NOT NULL)
{KS_SQL.format(keys='station, date', source='r')}""",
)
def kernel_rescaling(spark: SparkSession, sf: str) -> DataFrame:
    tau = intensity.rescaled_increments(tables.taps(spark, sf))
    tested = goodness.ks_statistic(tau, DAY, "tau", "expon")
    return rounded(tested.select("station", day("date").alias("date"), "n", "d_stat"))


@query(
    "t9_piecewise_rescaling",
    f"""WITH {O.TAPS}, w AS (SELECT station, {O.bucket(60)} AS w, count(*) AS n FROM taps GROUP BY ALL),
b AS (SELECT *, CAST(w AS DATE) AS d, (hour(w) * 60) // 360 AS seg FROM w),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY station, d, seg ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, sum(n) OVER (PARTITION BY station, d, seg) AS size FROM b),
e AS (SELECT s.station, s.d, s.seg, ts, event_id, base + n * (epoch_us(ts) - epoch_us(w)) / 3.6e9 AS lv FROM taps t JOIN s ON s.station = t.station AND s.w = {O.bucket(60)} WHERE size >= 10),
g AS (SELECT station, d, seg, lv - lag(lv) OVER (PARTITION BY station, d, seg ORDER BY ts, event_id) AS tau FROM e),
r AS (SELECT station, {O.day('d')} AS date, CAST(seg AS INT) AS segment, 1 - exp(-tau) AS f, row_number() OVER (PARTITION BY station, d, seg ORDER BY tau) AS i,
      count(*) OVER (PARTITION BY station, d, seg) AS n FROM g WHERE tau IS NOT NULL)
{KS_SQL.format(keys='station, date, segment', source='r')}""",
)
def piecewise_rescaling(spark: SparkSession, sf: str) -> DataFrame:
    """Quarter-day segments with hourly steps and at least ten taps, to suit the density of the test events."""
    tau = process.piecewise_rescaled(tables.taps(spark, sf), 60, 360, 10)
    tested = goodness.ks_statistic(tau, process.SEGMENT, "tau", "expon")
    return rounded(tested.select("station", day("date").alias("date"), "segment", "n", "d_stat"))


TRANSFORM_SQL = f"""{O.TAPS}, w AS (SELECT station, {O.bucket(60)} AS w, event_id, ts, (epoch_us(ts) - epoch_us({O.bucket(60)})) / 1e6 AS t,
  count(*) OVER (PARTITION BY station, {O.bucket(60)}) AS n, row_number() OVER (PARTITION BY station, {O.bucket(60)} ORDER BY ts, event_id) AS j FROM taps),
k AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY station, w ORDER BY j), 0) AS tp FROM w WHERE n >= 2),
cu AS (SELECT *, t / 3600e0 AS cu, -(n + 1 - j) * ln(greatest((3600e0 - t) / (3600e0 - tp), 1e-12)) AS lg FROM k),
sp AS (SELECT station, w, n, (t - tp) / 3600e0 AS c FROM k UNION ALL SELECT station, w, n, (3600e0 - t) / 3600e0 FROM k WHERE j = n),
so AS (SELECT *, row_number() OVER p AS j, c - coalesce(lag(c) OVER p, 0) AS dc FROM sp WINDOW p AS (PARTITION BY station, w ORDER BY c)),
le AS (SELECT station, w, j, sum((n + 2 - j) * dc) OVER (PARTITION BY station, w ORDER BY j) AS s FROM so)"""


def _transforms(spark: SparkSession, sf: str) -> DataFrame:
    return process.arrival_transforms(tables.taps(spark, sf), 60, 1440)


def _window_key(df: DataFrame, value: str, digits: int = 6) -> DataFrame:
    return rounded(df.select("station", F.date_format("window", "yyyy-MM-dd HH:mm:ss").alias("w"), "j", value), digits)


@query("t10_conditional_uniform", f"WITH {TRANSFORM_SQL} SELECT station, {O.stamp('w')} AS w, CAST(j AS INT) AS j, round(cu, 6) AS cu FROM cu")
def conditional_uniform(spark: SparkSession, sf: str) -> DataFrame:
    return _window_key(_transforms(spark, sf), "cu")


@query("t11_log_transform", f"WITH {TRANSFORM_SQL} SELECT station, {O.stamp('w')} AS w, CAST(j AS INT) AS j, round(lg, 6) AS log_exp FROM cu")
def log_transform(spark: SparkSession, sf: str) -> DataFrame:
    return _window_key(_transforms(spark, sf), "log_exp")


@query(
    "t12_lewis_durbin",
    f"WITH {TRANSFORM_SQL} SELECT station, {O.stamp('w')} AS w, CAST(j AS INT) AS j, round(s, 10) AS lewis FROM le JOIN cu USING (station, w, j)",
)
def lewis_durbin(spark: SparkSession, sf: str) -> DataFrame:
    return _window_key(_transforms(spark, sf), "lewis", 10)


@query(
    "t13_arrival_tests",
    f"""WITH {TRANSFORM_SQL},
x AS (SELECT station, CAST(w AS DATE) AS d, 'cu' AS transform, cu AS f FROM cu UNION ALL SELECT station, CAST(w AS DATE), 'log', 1 - exp(-lg) FROM cu
 UNION ALL SELECT station, CAST(w AS DATE), 'lewis', s FROM le JOIN cu USING (station, w, j)),
r AS (SELECT station, {O.day('d')} AS date, transform, f, row_number() OVER (PARTITION BY station, d, transform ORDER BY f) AS i,
      count(*) OVER (PARTITION BY station, d, transform) AS n FROM x)
SELECT * FROM ({KS_SQL.format(keys='station, date, transform', source='r')}) WHERE n >= 10""",
)
def arrival_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Whole days as segments and hourly windows, to suit the density of the test events."""
    tested = process.arrival_tests(tables.taps(spark, sf), 60, 1440)
    return rounded(tested.select("station", day("date").alias("date"), "transform", "n", "d_stat"))


@query("t13_arrival_tests_jittered")
def arrival_tests_jittered(spark: SparkSession, sf: str) -> DataFrame:
    """With sub-second jitter and bursts collapsed first."""
    tested = process.arrival_tests(tables.taps(spark, sf), 60, 1440, jitter_s=1.0, batch_gap_s=5.0)
    return rounded(tested.select("station", day("date").alias("date"), "transform", "n", "d_stat", "p_value"))


@query(
    "t14_cameron_trivedi",
    f"""WITH {O.minute_series()}, h AS (SELECT *, avg(n) OVER (PARTITION BY station, d, minute // 60) AS mu FROM series),
q AS (SELECT station, d, mu, pow(n - mu, 2) / mu AS r2 FROM h WHERE mu > 0),
f AS (SELECT station, d, count(*) AS m, regr_sxx(r2, mu) AS sxx, regr_syy(r2, mu) AS syy, regr_sxy(r2, mu) AS sxy FROM q GROUP BY ALL),
s AS (SELECT *, CASE WHEN sxx > 1e-12 THEN sxy / sxx END AS slope FROM f)
SELECT station, {O.day('d')} AS date, m, round(slope, 8) AS slope, CASE WHEN greatest(syy - slope * sxy, 0) / nullif(m - 2, 0) / nullif(sxx, 0) > 1e-18
 THEN round(slope / sqrt(greatest(syy - slope * sxy, 0) / nullif(m - 2, 0) / nullif(sxx, 0)), 8) END AS z FROM s""",
)
def cameron_trivedi(spark: SparkSession, sf: str) -> DataFrame:
    series = intensity.minute_series(intensity.minute_counts(tables.taps(spark, sf)))
    tested = process.cameron_trivedi(series, DAY)
    return rounded(tested.select("station", day("date").alias("date"), "m", "slope", "z"), 8)


@query(
    "t15_ljung_box",
    f"""WITH {O.minute_series()}, b AS (SELECT station, d, minute // 5 AS slot, sum(n) AS x FROM series GROUP BY ALL),
c AS (SELECT station, d, slot, x - avg(x) OVER (PARTITION BY station, d) AS c, row_number() OVER (PARTITION BY station, d ORDER BY slot) AS i, count(*) OVER (PARTITION BY station, d) AS n FROM b),
z AS (SELECT station, d, sum(c * c) AS c0 FROM c GROUP BY ALL),
l AS (SELECT a.station, a.d, k, max(a.n) AS n, sum(a.c * y.c) AS ck FROM c a, (SELECT unnest(range(1, 31)) AS k) JOIN c y ON y.station = a.station AND y.d = a.d AND y.i = a.i - k GROUP BY ALL)
SELECT l.station, {O.day('l.d')} AS date, max(n) AS n, CAST(m AS INT) AS lag, round(max(n) * (max(n) + 2) * sum(pow(ck / c0, 2) / (n - k)), 6) AS q_stat
FROM l JOIN z ON z.station = l.station AND z.d = l.d, (SELECT unnest([10, 20, 30]) AS m) WHERE k <= m GROUP BY ALL""",
)
def ljung_box(spark: SparkSession, sf: str) -> DataFrame:
    tested = goodness.ljung_box(_five_minute_series(spark, sf), DAY, ["slot"], "x")
    return rounded(tested.select("station", day("date").alias("date"), "n", "lag", "q_stat"))

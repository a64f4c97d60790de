"""Scalar-function queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemeter.functions import calendar as K
from tidemeter.functions import columns as C
from tidemeter.operators import curves as V
from tidemeter.operators.split import small
from tidemeter.operators import families, intensity, rates
from tidemeter.plans import oracle as O
from tidemeter.plans.registry import day, query, rounded, stamp
from tidemeter.sources import tables


def _broken_field() -> "F.Column":
    """Raw field with every kind of damage: complete, no closing bracket, no brackets, nested brackets."""
    kind = F.col("event_id") % 4
    return (
        F.when(kind == 0, F.col("station_field"))
        .when(kind == 1, F.replace(F.col("station_field"), F.lit(")"), F.lit("")))
        .when(kind == 2, F.col("station"))
        .otherwise(F.concat("station_field", F.lit(" (Sur) ")))
    )


BROKEN = """CASE event_id % 4 WHEN 0 THEN station_field WHEN 1 THEN replace(station_field, ')', '')
  WHEN 2 THEN station ELSE station_field || ' (Sur) ' END"""


@query(
    "p1_station_code_name",
    f"""WITH {O.TAPS}, b AS (SELECT event_id, {BROKEN} AS f FROM taps)
SELECT event_id,
       CASE WHEN contains(f, '(') AND contains(f, ')') THEN trim(replace(split_part(f, ')', 1), '(', '')) END AS code,
       CASE WHEN contains(f, '(') AND contains(f, ')') THEN trim(split_part(f, ')', 2)) END AS name
FROM b""",
)
def station_code_name(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.taps(spark, sf).withColumn("f", _broken_field())
    return rows.select("event_id", C.station_code("f").alias("code"), C.station_name("f").alias("name"))


@query(
    "p2_station_code_lenient",
    f"""WITH {O.TAPS}, b AS (SELECT event_id, {BROKEN} AS f FROM taps)
SELECT event_id, CASE WHEN contains(f, '(') THEN trim(replace(split_part(f, ')', 1), '(', '')) END AS code FROM b""",
)
def station_code_lenient(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.taps(spark, sf).withColumn("f", _broken_field())
    return rows.select("event_id", C.station_code_lenient("f").alias("code"))


@query(
    "p3_date_time_strings",
    f"""SELECT event_id, {O.stamp("CAST(strftime(ts, '%Y-%m-%d') || ' ' || strftime(ts, '%H:%M') || ':00' AS TIMESTAMP)")} AS ts FROM events""",
)
def date_time_strings(spark: SparkSession, sf: str) -> DataFrame:
    raw = tables.taps(spark, sf).select("event_id", day("ts").alias("d"), F.date_format("ts", "HH:mm").alias("t"))
    return raw.select("event_id", stamp(C.join_date_time("d", "t")).alias("ts"))


@query(
    "p4_floor_windows",
    "SELECT event_id, " + ", ".join(f"{O.stamp(O.bucket(m))} AS w{m}" for m in (1, 5, 15)) + " FROM events",
)
def floor_windows(spark: SparkSession, sf: str) -> DataFrame:
    return tables.taps(spark, sf).select(
        "event_id", *[stamp(C.floor_minutes("ts", m)).alias(f"w{m}") for m in (1, 5, 15)]
    )


@query(
    "p5_ceil_window",
    f"""SELECT event_id, {O.stamp("CASE WHEN time_bucket(INTERVAL '5 minutes', ts) = ts THEN ts ELSE time_bucket(INTERVAL '5 minutes', ts) + INTERVAL 5 MINUTE END")} AS w FROM events""",
)
def ceil_window(spark: SparkSession, sf: str) -> DataFrame:
    return tables.taps(spark, sf).select("event_id", stamp(C.ceil_minutes("ts", 5)).alias("w"))


@query(
    "p6_calendar_fields",
    """SELECT event_id, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day,
CAST(isodow(ts) - 1 AS INT) AS day_of_week FROM events""",
)
def calendar_fields(spark: SparkSession, sf: str) -> DataFrame:
    return tables.taps(spark, sf).select("event_id", *C.calendar_keys("ts")).drop("time")


@query("p7_hhmm", f"SELECT event_id, CAST({O.HHMM} AS INT) AS time FROM events")
def hhmm(spark: SparkSession, sf: str) -> DataFrame:
    return tables.taps(spark, sf).select("event_id", C.hhmm("ts").alias("time"))


@query(
    "p8_hhmm_minutes",
    """SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS INT) AS minutes, CAST(hour(ts) * 100 + minute(ts) AS INT) AS time FROM events""",
)
def hhmm_minutes(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.taps(spark, sf).select("event_id", C.hhmm_to_minutes(C.hhmm("ts")).alias("minutes"))
    return rows.withColumn("time", C.minutes_to_hhmm("minutes"))


@query(
    "p9_week_of_month",
    f"""SELECT DISTINCT {O.day('o_orderdate')} AS date,
CAST(ceil((day(o_orderdate) + isodow(date_trunc('month', o_orderdate)) - 1) / 7.0) AS INT) AS week FROM orders""",
)
def week_of_month(spark: SparkSession, sf: str) -> DataFrame:
    days = tables.order_values(spark, sf).select(F.to_date("ts").alias("d")).distinct()
    return days.select(day("d").alias("date"), C.week_of_month("d").alias("week"))


@query(
    "p10_day_type",
    f"""WITH {O.holidays('orders', 'o_orderdate')}
SELECT {O.day('o_orderdate')} AS date, {O.day_type('CAST(o_orderdate AS DATE)')} AS date_type, count(*) AS n FROM orders GROUP BY ALL""",
)
def day_type(spark: SparkSession, sf: str) -> DataFrame:
    days = tables.order_values(spark, sf).groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return K.with_day_type(days, "d").select(day("d").alias("date"), "date_type", "n")


@query(
    "p11_holiday_calendar",
    f"""WITH {O.holidays('orders', 'o_orderdate')},
days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT {O.day('d')} AS date, holiday FROM days LEFT JOIN holidays USING (d)""",
)
def holiday_calendar(spark: SparkSession, sf: str) -> DataFrame:
    days = tables.order_values(spark, sf).select(F.to_date("ts").alias("date"))
    return K.day_calendar(days).select(day("date").alias("date"), "holiday")


@query("p12_operating_window", f"SELECT event_id FROM events WHERE {O.OPEN}")
def operating_window(spark: SparkSession, sf: str) -> DataFrame:
    return tables.taps(spark, sf).where(C.in_hours(C.hhmm("ts"))).select("event_id")


@query(
    "p13_station_match",
    f"""WITH {O.TAPS} SELECT event_id, regexp_matches(station_field, '(?i)11804') AS by_code, regexp_matches(station_field, '(?i)SIGN') AS by_text,
split_part(station_field, ')', 1) = '(11804' AS exact FROM taps WHERE regexp_matches(station_field, '(?i)11804|SIGN')""",
)
def station_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.taps(spark, sf).where(C.station_matches("station_field", "11804|SIGN"))
    return rows.select(
        "event_id",
        C.station_matches("station_field", "11804").alias("by_code"),
        C.station_matches("station_field", "SIGN").alias("by_text"),
        (C.station_code("station_field") == "11804").alias("exact"),
    )


@query("p14_on_date", "SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-12'")
def on_date(spark: SparkSession, sf: str) -> DataFrame:
    return tables.events(spark, sf).where(C.on_date("ts", "2024-01-12")).select("event_id", "event_type")


@query(
    "p15_date_range",
    """SELECT o_orderpriority AS station, count(*) AS n, round(sum(o_totalprice), 2) AS value FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-11-15' AND DATE '1999-02-10' GROUP BY ALL""",
)
def date_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.order_values(spark, sf).where(C.between_dates("year", "month", "day", "1996-11-15", "1999-02-10"))
    return rounded(rows.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")), 2)


@query(
    "p16_null_handling",
    f"""WITH {O.TAPS}, b AS (SELECT {BROKEN} AS f, nullif(event_id % 5, 0) * exits AS v FROM taps),
c AS (SELECT CASE WHEN contains(f, '(') AND contains(f, ')') THEN trim(replace(split_part(f, ')', 1), '(', '')) END AS code, v FROM b)
SELECT code, count(*) AS n, round(sum(coalesce(v, 0)), 4) AS total, round(avg(coalesce(v, 0)), 6) AS mean FROM c WHERE code IS NOT NULL GROUP BY code""",
)
def null_handling(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.taps(spark, sf).select(
        C.station_code(_broken_field()).alias("code"), (F.nullif(F.col("event_id") % 5, F.lit(0)) * F.col("exits")).alias("v")
    )
    filled = rows.na.drop(subset=["code"]).na.fill(0.0, subset=["v"])
    out = filled.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.avg("v").alias("mean"))
    return out.select("code", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


@query(
    "p17_elapsed_time",
    f"""WITH {O.TAPS}, f AS (SELECT station, CAST(ts AS DATE) AS d, min(ts) AS t0 FROM taps GROUP BY ALL)
SELECT event_id, round((epoch_us(ts) - epoch_us(t0)) / 1e6, 9) AS elapsed_s,
       round((epoch_us(ts) - epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP))) / 6e7, 9) AS minute
FROM taps JOIN f ON f.station = taps.station AND f.d = CAST(ts AS DATE)""",
)
def elapsed_time(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.taps(spark, sf).withColumn("d", F.to_date("ts"))
    first = small(rows.groupBy("station", "d").agg(F.min("ts").alias("t0")), "first-taps")
    return rounded(
        rows.join(first, ["station", "d"]).select(
            "event_id", C.seconds_between("ts", "t0").alias("elapsed_s"), C.fractional_minute("ts").alias("minute")
        ),
        9,
    )


@query(
    "p18_jitter",
    f"""SELECT event_id, CAST(epoch_us(ts) + floor({O.unit_hash(42, 'event_id')} * 1e6) AS BIGINT) AS us FROM events""",
)
def jitter(spark: SparkSession, sf: str) -> DataFrame:
    return tables.taps(spark, sf).select("event_id", F.unix_micros(C.jitter("ts", "event_id")).alias("us"))


@query(
    "p19_curve_shares",
    f"""WITH {O.rate_facts(60)}, r AS (SELECT * FROM rates WHERE time BETWEEN 400 AND 2300)
SELECT station, {O.day('CAST(w AS DATE)')} AS date, CAST(row_number() OVER p - 1 AS INT) AS pos,
       round(lambda_in / sum(lambda_in) OVER (PARTITION BY station, CAST(w AS DATE)), 6) AS share
FROM r WINDOW p AS (PARTITION BY station, CAST(w AS DATE) ORDER BY w)""",
)
def curve_shares(spark: SparkSession, sf: str) -> DataFrame:
    curves = V.daily_curves(rates.rate_facts(tables.taps(spark, sf), 60), "lambda_in", min_points=1)
    shares = curves.withColumn("curve", V.normalise(F.col("curve"))).withColumn("date", C.date_of("year", "month", "day"))
    return rounded(shares.select("station", day("date").alias("date"), F.posexplode("curve").alias("pos", "share")))


@query(
    "p20_dispersion_verdict",
    f"""WITH {O.TAPS}, c AS (SELECT station, {O.bucket(5)} AS w, count(*) AS n FROM taps GROUP BY ALL),
v AS (SELECT station, CAST(w AS DATE) AS d, var_samp(n) / avg(n) AS vmr FROM c GROUP BY ALL)
SELECT station, {O.day('d')} AS date, round(vmr, 9) AS vmr,
       CASE WHEN vmr > 1.2 THEN 'overdispersed' WHEN vmr < 0.8 THEN 'underdispersed' WHEN vmr IS NOT NULL THEN 'adequate' END AS verdict
FROM v""",
)
def dispersion_verdict(spark: SparkSession, sf: str) -> DataFrame:
    counts = rates.window_counts(tables.taps(spark, sf), 5)
    ratio = counts.groupBy("station", F.to_date("w").alias("d")).agg((F.var_samp("n") / F.avg("n")).alias("vmr"))
    return rounded(ratio.select("station", day("d").alias("date"), "vmr", C.dispersion_verdict("vmr").alias("verdict")), 9)


@query("p21_exponential_pit", "SELECT event_id, round(1 - exp(-value / 50e0), 6) AS pit FROM events")
def exponential_pit(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.taps(spark, sf)
    return rounded(rows.select("event_id", C.exponential_pit(F.col("exits") / 50.0).alias("pit")))


@query(
    "p22_nb_parameters",
    f"""WITH {O.TAPS}, c AS (SELECT station, {O.bucket(60)} AS w, count(*) AS n FROM taps GROUP BY ALL),
s AS (SELECT station, CAST(w AS DATE) AS d, avg(n) AS mu, var_samp(n) AS var FROM c GROUP BY ALL HAVING var_samp(n) > 0),
k AS (SELECT *, greatest((var - mu) / (mu * mu), 0.001e0) AS k FROM s)
SELECT station, {O.day('d')} AS date, round(mu / (mu + k * mu * mu), 6) AS p, round(mu * mu / (mu + k * mu * mu - mu), 4) AS r,
       round(greatest(1 / k, 1e-6) / (greatest(1 / k, 1e-6) + mu), 6) AS p_from_r FROM k""",
)
def nb_parameters(spark: SparkSession, sf: str) -> DataFrame:
    counts = rates.window_counts(tables.taps(spark, sf), 60)
    stats = counts.groupBy("station", F.to_date("w").alias("d")).agg(F.avg("n").alias("mu"), F.var_samp("n").alias("var"))
    sized = stats.where("var > 0").withColumn("k", F.greatest((F.col("var") - F.col("mu")) / (F.col("mu") * F.col("mu")), F.lit(0.001)))
    return sized.select(
        "station",
        day("d").alias("date"),
        F.round(C.nb_p_from_k("mu", "k"), 6).alias("p"),
        F.round(C.nb_r_from_k("mu", "k"), 4).alias("r"),
        F.round(C.nb_p_from_r(1 / F.col("k"), "mu"), 6).alias("p_from_r"),
    )


def _family_sql() -> str:
    """Mean value function of a parameter row (family, p1..p4) at t."""
    fourier = ""
    for which, (constant, sines, cosines) in families.FOURIER_SETS.items():
        terms = [f"{constant}e0 * t"]
        terms += [f"{w}e0 / {k * families.PERIOD!r}::DOUBLE * (1 - cos({k * families.PERIOD!r}::DOUBLE * t))" for w, k in sines]
        terms += [f"{w}e0 / {k * families.PERIOD!r}::DOUBLE * sin({k * families.PERIOD!r}::DOUBLE * t)" for w, k in cosines]
        fourier += f" WHEN family = 'fourier' AND p1 = {which} THEN {' + '.join(terms)}"
    mixture = " + ".join(f"{w}e0 * {O.normal_cdf(f'((t - {c}e0) / {s}e0)')}" for w, c, s in families.MIXTURE)
    return f"""CASE family WHEN 'crow_amsaa' THEN pow(t / p2, p1)
 WHEN 'goel_okumoto' THEN p1 * (1 - exp(-p2 * t))
 WHEN 'musa_okumoto' THEN ln(1 + p2 * p1 * t) / p2
 WHEN 'yamada_s' THEN p1 * (1 - (1 + p2 * t) * exp(-p2 * t))
 WHEN 'rayleigh' THEN p1 * (1 - exp(-p2 * t * t))
 WHEN 'logistic' THEN p1 / (1 + p3 * exp(-p2 * t))
 WHEN 'gompertz' THEN p1 * exp(-p3 * exp(-p2 * t))
 WHEN 'sinusoidal' THEN p1 * t + p2 / p3 * (cos(p4) - cos(p3 * t + p4))
 WHEN 'gaussian_mixture' THEN {mixture}
 ELSE CASE{fourier} END END"""


def _parameter_sql() -> str:
    show = lambda v: "NULL::DOUBLE" if v is None else f"{v!r}::DOUBLE"
    return ", ".join(f"('{r[0]}', {', '.join(show(v) for v in r[1:])})" for r in families.PARAMETER_SETS)


@query(
    "p23_rate_families",
    f"""WITH {O.dense(60)},
cum AS (SELECT station, date_type, time, sum(count_in) OVER (PARTITION BY station, date_type, date ORDER BY time) AS c FROM dense),
mvf AS (SELECT station, date_type, (time // 100 * 60 + 60) / 144e0 AS t, avg(c) AS m FROM cum GROUP BY ALL),
params(family, p1, p2, p3, p4) AS (VALUES {_parameter_sql()}),
scored AS (SELECT station, date_type, family, p1, p2, m, {_family_sql()} AS model FROM mvf, params)
SELECT station, date_type, family, p1, p2, round(sum((m - model) * (m - model)), 4) AS sse FROM scored GROUP BY ALL""",
)
def rate_families(spark: SparkSession, sf: str) -> DataFrame:
    """Parametric mean value functions against the observed one; a day is ten time units long."""
    facts = rates.count_facts(tables.taps(spark, sf), 60).where(C.in_hours("time"))
    observed = V.mean_value_function(V.dense_slots(facts, ["count_in"]), "count_in")
    curves = observed.withColumn("t", (C.hhmm_to_minutes("time") + 60) / 144.0)
    return rounded(families.score_families(curves, ["station", "date_type"]), 4)


@query(
    "p24_variance_curve",
    f"""WITH {O.minute_grid()},
b AS (SELECT station, d, (minute - 240) // 5 AS bin, avg(lam) AS ml FROM grid GROUP BY ALL),
top AS (SELECT station, d, greatest(max(ml), 1e0) AS top FROM b GROUP BY ALL),
k AS (SELECT station, d, greatest((var_samp(n) - avg(n)) / (avg(n) * avg(n)), 0e0) AS k FROM grid GROUP BY ALL),
g AS (SELECT station, d, k, i, 0.01e0 + (top - 0.01e0) * i / 199e0 AS mu FROM top JOIN k USING (station, d), (SELECT unnest(range(0, 200)) AS i))
SELECT station, {O.day('d')} AS date, CAST(i AS INT) AS i, round(mu, 6) AS mu, round(mu + k * mu * mu, 6) AS variance FROM g""",
)
def variance_curve(spark: SparkSession, sf: str) -> DataFrame:
    grid = intensity.kernel_intensity(tables.taps(spark, sf))
    curve = intensity.variance_curve(intensity.binned_means(grid), intensity.moment_k(grid))
    return rounded(curve.select("station", day("date").alias("date"), "i", "mu", "variance"))

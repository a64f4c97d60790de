"""Join, aggregate, window, top-k and set queries on counts, trips and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemeter.functions import columns as C
from tidemeter.operators import cluster, curves, density, dispersion, goodness, hawkes, intensity, process, rates, sampling, split, trips
from tidemeter.operators import ranktests
from tidemeter.plans import oracle as O
from tidemeter.plans.registry import day, query, rounded, stamp
from tidemeter.plans.storage import STATIONS_SQL, station_dimension
from tidemeter.session import stored
from tidemeter.sources import facts as facts_io
from tidemeter.sources import stations as stations_io
from tidemeter.sources import tables

BIN, POINTS, LENGTH = 60, 10, 20  # hourly curves: the test events are too sparse for quarter hours


def _open_facts(spark: SparkSession, sf: str, minutes: int = BIN) -> DataFrame:
    """Facts of the open hours out of a written fact table, as they are read several times."""
    return stored(rates.count_facts(tables.taps(spark, sf), minutes), "facts").where(C.in_hours("time"))


def _dense(spark: SparkSession, sf: str, minutes: int = BIN) -> DataFrame:
    return curves.dense_slots(_open_facts(spark, sf, minutes), facts_io.COUNT_MEASURES)


def daily_curves(spark: SparkSession, sf: str) -> DataFrame:
    return curves.daily_curves(rates.rate_facts(tables.taps(spark, sf), BIN), "lambda_in", POINTS)


def aligned_curves(spark: SparkSession, sf: str, unit_sum: bool = True) -> DataFrame:
    return curves.aligned_curves(daily_curves(spark, sf), LENGTH, POINTS, unit_sum)


# --- joins -------------------------------------------------------------------------------------


@query(
    "j1_fact_station_join",
    f"""WITH {STATIONS_SQL}, c AS (SELECT trim(replace(split_part(station_field, ')', 1), '(', '')) AS code, {O.bucket(15)} AS w, count(*) AS n
  FROM taps GROUP BY ALL)
SELECT id AS station_id, code, name, {O.stamp('w')} AS w, n FROM c JOIN stations USING (code) WHERE id > 1""",
)
def fact_station_join(spark: SparkSession, sf: str) -> DataFrame:
    """Counts with their station id; one station is missing from the dimension and drops out."""
    taps = tables.taps(spark, sf).withColumn("code", C.station_code("station_field"))
    dimension = station_dimension(taps).where("id > 1")
    joined = stations_io.attach_station(rates.window_counts(taps, 15, ["code"]), dimension)
    return joined.select(F.col("id").alias("station_id"), "code", "name", stamp("w").alias("w"), "n")


@query(
    "j2_cluster_station_left_join",
    f"""WITH {STATIONS_SQL}, c AS (SELECT station, CAST(count(*) % 3 AS INT) AS cluster FROM taps GROUP BY station)
SELECT c.station, s.id, s.code, c.cluster FROM c LEFT JOIN stations s ON s.name = c.station AND s.id <> 3""",
)
def cluster_station_left_join(spark: SparkSession, sf: str) -> DataFrame:
    taps = tables.taps(spark, sf)
    labels = taps.groupBy("station").agg((F.count(F.lit(1)) % 3).cast("int").alias("cluster"))
    info = station_dimension(taps).where("id <> 3").withColumnRenamed("name", "station")
    return cluster.with_station_info(labels, info).select("station", "id", "code", "cluster")


@query(
    "j3_unknown_stations",
    f"""WITH {STATIONS_SQL}, old AS (SELECT code FROM members WHERE name < 'p')
SELECT code, name FROM members WHERE code NOT IN (SELECT code FROM old)""",
)
def unknown_stations(spark: SparkSession, sf: str) -> DataFrame:
    taps = tables.taps(spark, sf)
    known = station_dimension(taps.where("station < 'p'"))
    return stations_io.new_members(known, stations_io.members(taps)).select("code", "name")


@query(
    "j4_repeat_card_rows",
    f"""WITH {O.TAPS}, d AS (SELECT *, CAST(ts AS DATE) AS d FROM taps),
q AS (SELECT card, d FROM d GROUP BY ALL HAVING count(*) >= 2)
SELECT event_id, card FROM d SEMI JOIN q USING (card, d)""",
)
def repeat_card_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Taps of cards used at least twice on the same day."""
    taps = tables.taps(spark, sf).select("event_id", F.struct("card", F.to_date("ts").alias("d")).alias("card"))
    return trips.repeat_card_rows(taps).select("event_id", "card.card")


@query(
    "j5_trips",
    f"""WITH {O.trips()} SELECT card, origin, destination, {O.stamp('t1', True)} AS t1, {O.stamp('t2', True)} AS t2 FROM trips""",
)
def trip_list(spark: SparkSession, sf: str) -> DataFrame:
    found = trips.trips(tables.taps(spark, sf))
    return found.select("card", "origin", "destination", stamp("t1", True).alias("t1"), stamp("t2", True).alias("t2"))


@query(
    "j6_sampled_rate",
    f"""WITH {O.ticks(15)} SELECT station, {O.stamp('tick')} AS tick, round(estimate, 6) AS estimate FROM sampled""",
)
def sampled_rate(spark: SparkSession, sf: str) -> DataFrame:
    ticks = rates.sampled_rate(tables.taps(spark, sf), 15)
    return rounded(ticks.select("station", stamp("tick").alias("tick"), "estimate"))


@query(
    "j7_compensator_lookup",
    f"""WITH {O.minute_grid()},
comp AS (SELECT *, sum(lam) OVER (PARTITION BY station, d ORDER BY minute) AS comp FROM grid)
SELECT event_id, round(comp, 6) AS compensator FROM taps t
JOIN comp c ON c.station = t.station AND c.d = CAST(t.ts AS DATE) AND c.minute = hour(t.ts) * 60 + minute(t.ts) WHERE {O.OPEN}""",
)
def compensator_lookup(spark: SparkSession, sf: str) -> DataFrame:
    taps = tables.taps(spark, sf)
    grid = intensity.compensated(intensity.kernel_intensity(taps))
    return rounded(intensity.at_minute(taps, grid, "compensator").select("event_id", "compensator"))


@query(
    "j8_interpolated_intensity",
    f"""WITH {O.minute_grid()},
e AS (SELECT *, lead(lam) OVER (PARTITION BY station, d ORDER BY minute) AS lam1 FROM grid),
f AS (SELECT event_id, station, CAST(ts AS DATE) AS d, hour(ts) * 60 + minute(ts) AS minute,
             (epoch_us(ts) - epoch_us(date_trunc('minute', ts))) / 6e7 AS frac FROM taps WHERE {O.OPEN})
SELECT event_id, round(lam + (coalesce(lam1, lam) - lam) * frac, 6) AS intensity FROM f JOIN e USING (station, d, minute)""",
)
def interpolated_intensity(spark: SparkSession, sf: str) -> DataFrame:
    taps = tables.taps(spark, sf)
    rows = intensity.interpolated(taps, intensity.kernel_intensity(taps), "intensity", "level")
    return rounded(rows.select("event_id", F.col("level").alias("intensity")))


@query(
    "j9_samples_to_windows",
    f"""WITH {O.minute_grid()}
SELECT station, {O.day('d')} AS date, CAST(minute // 15 * 15 AS INT) AS minute, round(sum(lam), 6) AS predicted FROM grid GROUP BY ALL""",
)
def samples_to_windows(spark: SparkSession, sf: str) -> DataFrame:
    grid = intensity.kernel_intensity(tables.taps(spark, sf)).withColumnRenamed("minute", "t")
    totals = curves.window_totals(grid, ["station", "date"], "t", "intensity", 15)
    return rounded(totals.select("station", day("date").alias("date"), "minute", "predicted"))


@query(
    "j10_dense_minutes",
    f"""WITH {O.minute_series()} SELECT station, {O.day('d')} AS date, CAST(minute AS INT) AS minute, n FROM series""",
)
def dense_minutes(spark: SparkSession, sf: str) -> DataFrame:
    series = intensity.minute_series(intensity.minute_counts(tables.taps(spark, sf)))
    return series.select("station", day("date").alias("date"), "minute", "n")


@query(
    "j11_dense_slots",
    f"""WITH {O.dense(60)} SELECT station, date_type, {O.day('date')} AS date, time, CAST(count_in AS BIGINT) AS count_in,
CAST(count_out AS INT) AS count_out FROM dense""",
)
def dense_slots(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf).select("station", "date_type", day("date").alias("date"), "time", "count_in", "count_out")


PAIRS_SQL = """zc AS (SELECT *, v - avg(v) OVER (PARTITION BY station, year, month, day) AS c FROM cp),
z AS (SELECT *, sqrt(sum(c * c) OVER (PARTITION BY station, year, month, day)) AS norm FROM zc),
pr AS (SELECT a.station, a.{label} AS label, make_date(a.year, a.month, a.day) AS d1, make_date(b.year, b.month, b.day) AS d2, corr(a.v, b.v) AS r
       FROM z a JOIN z b ON a.station = b.station AND a.{label} = b.{label} AND a.pos = b.pos
        AND (a.year, a.month, a.day) < (b.year, b.month, b.day)
       WHERE a.norm > 1e-12 AND b.norm > 1e-12 {where} GROUP BY ALL)"""


@query(
    "j12_curve_pair_sums",
    f"""WITH {O.curves(60, 10, 20)}, {PAIRS_SQL.format(label='date_type', where='')}
SELECT station, label AS date_type, count(*) AS pairs, round(sum(r), 6) AS sum_r FROM pr GROUP BY ALL""",
)
def curve_pair_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Number and summed correlation of all curve pairs of a group, from the Gram identity."""
    pairs = cluster.pair_correlation(aligned_curves(spark, sf), ["station", "date_type"])
    n = F.col("n_curves") * (F.col("n_curves") - 1) / 2
    return rounded(pairs.select("station", "date_type", n.cast("bigint").alias("pairs"), (F.col("mean_corr") * n).alias("sum_r")))


HOLDOUT_SQL = """fx2 AS (SELECT station, date_type, make_date(year, month, day) AS date, time, count_in, count_out FROM facts WHERE time BETWEEN 400 AND 2300),
last AS (SELECT station, date_type, max(date) AS held FROM fx2 GROUP BY ALL),
tr AS (SELECT f.* FROM fx2 f JOIN last USING (station, date_type) WHERE date < held),
te AS (SELECT f.* FROM fx2 f JOIN last USING (station, date_type) WHERE date = held),
dd AS (SELECT g.station, g.date_type, g.date, s.time, coalesce(f.count_in, 0) AS c
       FROM (SELECT DISTINCT station, date_type, date FROM tr) g
       JOIN (SELECT DISTINCT station, date_type, time FROM tr) s ON g.station = s.station AND g.date_type = s.date_type
       LEFT JOIN tr f ON f.station = g.station AND f.date_type = g.date_type AND f.date = g.date AND f.time = s.time),
pred AS (SELECT station, date_type, time, avg(c) AS predicted FROM dd GROUP BY ALL),
pairs AS (SELECT te.station, te.date_type, te.time, coalesce(te.count_in, 0) AS actual, predicted FROM te JOIN pred USING (station, date_type, time))"""


@query(
    "j13_predicted_actual",
    f"""WITH {O.count_facts(60)}, {HOLDOUT_SQL}
SELECT station, date_type, time, CAST(actual AS BIGINT) AS actual, round(predicted, 6) AS predicted FROM pairs""",
)
def predicted_actual(spark: SparkSession, sf: str) -> DataFrame:
    train, test = curves.holdout_split(_open_facts(spark, sf))
    mean = curves.average_curve(curves.dense_slots(train, ["count_in"]), ["count_in"], BIN)
    keys = ["station", "date_type", "time"]
    pairs = test.select(*keys, F.coalesce("count_in", F.lit(0)).alias("actual")).join(mean, keys)
    return rounded(pairs.select(*keys, "actual", F.col("mean_count_in").alias("predicted")))


@query(
    "j14_kernel_sums",
    f"""WITH {O.minute_grid()} SELECT station, {O.day('d')} AS date, CAST(minute AS INT) AS minute, round(lam * 5e0 * sqrt(2 * pi()), 6) AS weight FROM grid""",
)
def kernel_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Unnormalised Gaussian weight of all taps of a day at every grid minute."""
    grid = intensity.kernel_intensity(tables.taps(spark, sf))
    weight = F.col("intensity") * 5.0 * F.sqrt(2 * F.pi())
    return rounded(grid.select("station", day("date").alias("date"), "minute", weight.alias("weight")))


# --- aggregates --------------------------------------------------------------------------------


@query("a1_window_counts", f"WITH {O.TAPS} SELECT station, {O.stamp(O.bucket(5))} AS w, count(*) AS n FROM taps GROUP BY ALL")
def window_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rates.window_counts(tables.taps(spark, sf), 5).select("station", stamp("w").alias("w"), "n")


@query(
    "a2_rate_in",
    f"""WITH {O.rate_facts(15)}, z AS (SELECT station, {O.bucket(15)} AS w, count(*) / 3e0 AS filled FROM taps GROUP BY ALL)
SELECT station, {O.stamp('w')} AS w, round(lambda_in, 6) AS lambda_in, round(filled, 6) AS lambda_in_filled FROM rates JOIN z USING (station, w)""",
)
def rate_in(spark: SparkSession, sf: str) -> DataFrame:
    moments = rates.window_moments(tables.taps(spark, sf), 15, 5)
    both = moments.select("station", "window", (F.col("s") / F.col("m")).alias("lambda_in"), (F.col("s") / 3.0).alias("lambda_in_filled"))
    return rounded(both.select("station", stamp("window").alias("w"), "lambda_in", "lambda_in_filled"))


@query(
    "a3_rate_out",
    f"WITH {O.TAPS} SELECT station, {O.stamp(O.bucket(15))} AS w, round(sum(exits) / 3e0, 6) AS lambda_out FROM taps GROUP BY ALL",
)
def rate_out(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rates.rate_out(tables.taps(spark, sf)).select("station", stamp("window").alias("w"), "lambda_out"))


@query(
    "a4_counts_15min",
    f"""WITH {O.TAPS}, {O.holidays()},
m AS (SELECT trim(replace(split_part(station_field, ')', 1), '(', '')) AS station, date_trunc('minute', ts) AS m, count(*) AS n FROM taps GROUP BY ALL),
w AS (SELECT station, {O.bucket(15, 'm')} AS w, CAST(sum(n) AS BIGINT) AS count_in, coalesce(var_samp(n), 0) AS v FROM m GROUP BY ALL)
SELECT station, {O.calendar('w')}, count_in, round(v, 6) AS variance_in_1min FROM w""",
)
def counts_15min(spark: SparkSession, sf: str) -> DataFrame:
    """Quarter-hour totals and one-minute variance of every station, with calendar keys and day type."""
    keyed = tables.taps(spark, sf).withColumn("station", C.station_code("station_field")).where("station IS NOT NULL")
    facts = rates.with_calendar(rates.counts_in(keyed))
    ordered = facts.orderBy("station", "year", "month", "day", "time")
    return rounded(ordered.select(*rates.FACT_KEYS, "count_in", "variance_in_1min"))


@query(
    "a5_counts_out",
    f"WITH {O.TAPS} SELECT station, {O.stamp(O.bucket(15))} AS w, CAST(trunc(round(sum(exits), 6)) AS INT) AS count_out FROM taps GROUP BY ALL",
)
def counts_out(spark: SparkSession, sf: str) -> DataFrame:
    return rates.counts_out(tables.taps(spark, sf)).select("station", stamp("window").alias("w"), "count_out")


OVER_SQL = f"""{O.TAPS}, c AS (SELECT station, {O.bucket(5)} AS w5, count(*) AS n FROM taps WHERE {O.OPEN} GROUP BY ALL),
o AS (SELECT station, {O.bucket(15, 'w5')} AS w, avg(n) AS mean, var_samp(n) AS var, count(*) AS count, var_samp(n) / avg(n) AS overdispersion FROM c GROUP BY ALL)"""


@query(
    "a6_overdispersion",
    f"WITH {OVER_SQL} SELECT station, {O.stamp('w')} AS w, round(mean, 6) AS mean, round(var, 6) AS var, count, round(overdispersion, 6) AS overdispersion FROM o",
)
def overdispersion(spark: SparkSession, sf: str) -> DataFrame:
    table = rates.overdispersion(tables.taps(spark, sf))
    return rounded(table.select("station", stamp("window").alias("w"), "mean", "var", "count", "overdispersion"))


@query(
    "a7_mean_overdispersion",
    f"""WITH {OVER_SQL}, m AS (SELECT station, avg(overdispersion) AS x FROM o GROUP BY station)
SELECT station, round(x, 6) AS mean_overdispersion,
CASE WHEN x > 1.2 THEN 'overdispersed' WHEN x < 0.8 THEN 'underdispersed' WHEN x IS NOT NULL THEN 'adequate' END AS verdict FROM m""",
)
def mean_overdispersion(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rates.mean_overdispersion(tables.taps(spark, sf)))


@query(
    "a8_variance_to_mean",
    f"WITH {O.TAPS}, c AS (SELECT station, {O.bucket(5)} AS w, count(*) AS n FROM taps GROUP BY ALL) SELECT station, round(var_samp(n) / avg(n), 6) AS vmr FROM c GROUP BY station",
)
def variance_to_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rates.variance_to_mean(tables.taps(spark, sf)))


@query(
    "a9_card_summary",
    f"""WITH {O.TAPS}, c AS (SELECT card, count(*) AS n FROM taps GROUP BY card)
SELECT count(*) AS cards, count(*) FILTER (n > 1) AS repeat_cards, CAST(sum(n) - count(*) AS BIGINT) AS repeated_records,
       round(avg(n) FILTER (n > 1), 6) AS mean, round(stddev_samp(n) FILTER (n > 1), 6) AS std, min(n) FILTER (n > 1) AS min,
       max(n) FILTER (n > 1) AS max, round(quantile_cont(n, 0.25) FILTER (n > 1), 6) AS p25,
       round(quantile_cont(n, 0.5) FILTER (n > 1), 6) AS p50, round(quantile_cont(n, 0.75) FILTER (n > 1), 6) AS p75 FROM c""",
)
def card_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trips.repeat_summary(tables.taps(spark, sf)))


def _card_days(spark: SparkSession, sf: str) -> DataFrame:
    """Card and day as the card, so that exactly-two-tap cards occur in the test data."""
    card = F.concat_ws("-", F.col("card"), day("ts"))
    return tables.taps(spark, sf).withColumn("card", card)


CARD_DAYS_SQL = f"""{O.TAPS}, two AS (SELECT card || '-' || {O.day('ts')} AS card, (epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7 AS minutes
FROM taps GROUP BY 1 HAVING count(*) = 2)"""


@query(
    "a10_two_tap_gaps",
    f"WITH {CARD_DAYS_SQL} SELECT count(*) AS cards, round(avg(minutes), 6) AS mean, round(stddev_samp(minutes), 6) AS std FROM two",
)
def two_tap_gaps(spark: SparkSession, sf: str) -> DataFrame:
    gaps = trips.two_tap_gaps(_card_days(spark, sf))
    return rounded(gaps.agg(F.count("card").alias("cards"), F.avg("minutes").alias("mean"), F.stddev_samp("minutes").alias("std")))


@query(
    "a11_daily_curves",
    f"""WITH {O.rate_facts(60)}, r AS (SELECT *, count(*) OVER (PARTITION BY station, CAST(w AS DATE)) AS n_points FROM rates WHERE time BETWEEN 400 AND 2300)
SELECT station, {O.day('CAST(w AS DATE)')} AS date, date_type, CAST(n_points AS INT) AS n_points,
       CAST(row_number() OVER (PARTITION BY station, CAST(w AS DATE) ORDER BY time) - 1 AS INT) AS pos, round(lambda_in, 6) AS v
FROM r WHERE n_points >= 10""",
)
def curve_points(spark: SparkSession, sf: str) -> DataFrame:
    rows = daily_curves(spark, sf).withColumn("date", C.date_of("year", "month", "day"))
    return rounded(rows.select("station", day("date").alias("date"), "date_type", "n_points", F.posexplode("curve").alias("pos", "v")))


@query(
    "a12_resampled_curves",
    f"""WITH {O.curves(60, 10, 20, unit_sum=False)} SELECT station, {O.day('make_date(year, month, day)')} AS date, CAST(pos AS INT) AS pos, round(v, 6) AS v FROM cp""",
)
def resampled_curves(spark: SparkSession, sf: str) -> DataFrame:
    rows = aligned_curves(spark, sf, unit_sum=False).withColumn("date", C.date_of("year", "month", "day"))
    return rounded(rows.select("station", day("date").alias("date"), F.posexplode("curve").alias("pos", "v")))


@query(
    "a13_signatures",
    f"""WITH {O.curves(60, 10, 20)} SELECT station, date_type, CAST(pos AS INT) AS pos, round(avg(v), 8) AS v FROM cp GROUP BY ALL""",
)
def signatures(spark: SparkSession, sf: str) -> DataFrame:
    sigs = curves.signatures(aligned_curves(spark, sf))
    return rounded(sigs.select("station", "date_type", F.posexplode("curve").alias("pos", "v")), 8)


@query(
    "a13_signatures_time_range",
    f"""WITH {O.curves(60, 4, 9, start=600, end=1400)} SELECT station, date_type, CAST(pos AS INT) AS pos, round(avg(v), 8) AS v FROM cp GROUP BY ALL""",
)
def signatures_time_range(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures of 06:00 to 14:00 from days with at least half of its hours."""
    sigs = curves.range_signatures(rates.rate_facts(tables.taps(spark, sf), BIN), "lambda_in", 600, 1400, BIN, 0.5)
    return rounded(sigs.select("station", "date_type", F.posexplode("curve").alias("pos", "v")), 8)


@query(
    "a14_feature_columns",
    f"""WITH {O.curves(60, 10, 20)}, m AS (SELECT station, date_type, pos, avg(v) AS v FROM cp GROUP BY ALL)
SELECT station, date_type, {", ".join(f"round(max(v) FILTER (pos = {i}), 8) AS t_{i:02d}" for i in range(20))} FROM m GROUP BY ALL""",
)
def feature_columns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.feature_columns(curves.signatures(aligned_curves(spark, sf)), LENGTH), 8)


@query(
    "a15_average_curve",
    f"""WITH {O.dense(60)} SELECT station, date_type, time, round(avg(count_in), 6) AS mean_count_in, round(avg(count_out), 6) AS mean_count_out FROM dense GROUP BY ALL""",
)
def average_curve(spark: SparkSession, sf: str) -> DataFrame:
    mean = curves.average_curve(_dense(spark, sf), ["count_in", "count_out"], BIN)
    return rounded(mean.select("station", "date_type", "time", "mean_count_in", "mean_count_out"))


@query(
    "a16_raw_intensity",
    f"""WITH {O.dense(60)} SELECT station, date_type, time, round(avg(count_in) / 60e0, 8) AS rate_count_in FROM dense GROUP BY ALL""",
)
def raw_intensity(spark: SparkSession, sf: str) -> DataFrame:
    mean = curves.average_curve(_dense(spark, sf), ["count_in"], BIN)
    return rounded(mean.select("station", "date_type", "time", "rate_count_in"), 8)


@query(
    "a17_mean_value_function",
    f"""WITH {O.dense(60)}, c AS (SELECT *, sum(count_in) OVER (PARTITION BY station, date_type, date ORDER BY time) AS c FROM dense)
SELECT station, date_type, time, round(avg(c), 6) AS m FROM c GROUP BY ALL""",
)
def mean_value_function(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.mean_value_function(_dense(spark, sf), "count_in"))


@query(
    "a18_integrated_intensity",
    f"""WITH {O.dense(60)}, r AS (SELECT station, date_type, time // 100 * 60 + time % 100 AS t, avg(count_in) / 60e0 AS rate FROM dense GROUP BY ALL)
SELECT station, date_type, CAST(t AS INT) AS t,
       round(sum(rate) OVER (PARTITION BY station, date_type ORDER BY t)
             * (max(t) OVER p - min(t) OVER p) / (count(*) OVER p - 1), 6) AS m
FROM r WINDOW p AS (PARTITION BY station, date_type)""",
)
def integrated_intensity(spark: SparkSession, sf: str) -> DataFrame:
    mean = curves.average_curve(_dense(spark, sf), ["count_in"], BIN).withColumn("t", C.hhmm_to_minutes("time"))
    return rounded(curves.integrate(mean, ["station", "date_type"], "t", "rate_count_in").select("station", "date_type", "t", "m"))


@query(
    "a19_predicted_totals",
    f"""WITH {O.minute_grid()} SELECT station, {O.day('d')} AS date, CAST(minute // 60 * 60 AS INT) AS minute, round(sum(lam), 6) AS predicted FROM grid GROUP BY ALL""",
)
def predicted_totals(spark: SparkSession, sf: str) -> DataFrame:
    grid = intensity.kernel_intensity(tables.taps(spark, sf)).withColumnRenamed("minute", "t")
    totals = curves.window_totals(grid, ["station", "date"], "t", "intensity", 60)
    return rounded(totals.select("station", day("date").alias("date"), "minute", "predicted"))


@query(
    "a20_slot_dispersion",
    f"""WITH {O.dense(60)}, s AS (SELECT station, date_type, time, avg(count_in) AS mu, var_pop(count_in) AS var FROM dense GROUP BY ALL),
r AS (SELECT *, CASE WHEN var > mu + 1e-12 THEN mu * mu / (var - mu) END AS r FROM s)
SELECT station, date_type, time, round(coalesce(r, median(r) OVER p), 6) AS r, round(avg(CASE WHEN r IS NOT NULL THEN 1e0 ELSE 0 END) OVER p, 6) AS over_share
FROM r WINDOW p AS (PARTITION BY station, date_type)""",
)
def slot_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.slot_dispersion(_dense(spark, sf), "count_in").select("station", "date_type", "time", "r", "over_share"))


DAILY_R_SQL = f"""{O.dense(60)}, rd AS (SELECT *, count_in / 60e0 AS mu, CASE WHEN variance_in_1min > count_in / 60e0
  THEN (count_in / 60e0) * (count_in / 60e0) / (variance_in_1min - count_in / 60e0) END AS r_day FROM dense),
sl AS (SELECT station, date_type, time, median(r_day) AS r_slot FROM rd GROUP BY ALL),
r AS (SELECT station, date_type, time, greatest(coalesce(r_slot, median(r_slot) OVER (PARTITION BY station, date_type), 1e6), 1e-6) AS r FROM sl)"""


@query("a21_daily_dispersion", f"WITH {DAILY_R_SQL} SELECT station, date_type, time, round(r, 6) AS r FROM r")
def daily_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.daily_dispersion(_dense(spark, sf), "count_in", "variance_in_1min", BIN))


@query("a22_global_dispersion", f"WITH {DAILY_R_SQL} SELECT station, date_type, round(median(r), 6) AS r FROM r GROUP BY ALL")
def global_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    slots = curves.daily_dispersion(_dense(spark, sf), "count_in", "variance_in_1min", BIN)
    return rounded(curves.global_dispersion(slots))


@query(
    "a23_overdispersed_share",
    f"""WITH {DAILY_R_SQL}, o AS (SELECT station, date_type, time, bool_or(variance_in_1min > mu) AS over FROM rd GROUP BY ALL)
SELECT station, date_type, count(*) AS slots, count(*) FILTER (over) AS overdispersed, round(avg(CASE WHEN over THEN 1e0 ELSE 0 END), 6) AS share FROM o GROUP BY ALL""",
)
def overdispersed_share(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.overdispersed_share(_dense(spark, sf), "count_in", "variance_in_1min", BIN))


@query(
    "a24_moment_dispersion",
    f"""WITH {O.minute_series()} SELECT station, {O.day('d')} AS date, round(avg(n), 8) AS mean, round(var_samp(n), 8) AS var,
round(greatest((var_samp(n) - avg(n)) / (avg(n) * avg(n)), 0e0), 6) AS k FROM series GROUP BY ALL""",
)
def moment_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    k = intensity.moment_k(intensity.minute_series(intensity.minute_counts(tables.taps(spark, sf))))
    return k.select(
        "station", day("date").alias("date"), F.round("mean", 8).alias("mean"), F.round("var", 8).alias("var"), F.round("k", 6).alias("k")
    )


LINES_SQL = ", ".join(f"({r}, {a}, {b})" for r, (a, b) in enumerate(dispersion.resample_lines(200)))
WEIGHT_SQL = " ".join(f"WHEN u < {b!r} THEN {k}" for k, b in enumerate(dispersion.poisson_bounds()))


@query(
    "a25_bootstrap_dispersion",
    f"""WITH {O.minute_series()}, lines(r, a, b) AS (VALUES {LINES_SQL}),
h AS MATERIALIZED (SELECT station, d, n, CAST(floor({O.unit_hash(42, 'station', 'd', 'minute')} * 2147483647e0) AS BIGINT) AS key FROM series),
u AS (SELECT station, d, n, r, ((key * a + b) % 2147483647) / 2147483647e0 AS u FROM h, lines),
w AS (SELECT station, d, n, r, CASE {WEIGHT_SQL} ELSE 13 END AS w FROM u),
s AS (SELECT station, d, sum(w) AS size, sum(w * n) AS total, sum(w * n * n) AS square FROM w GROUP BY station, d, r),
k AS (SELECT station, d, CASE WHEN total > 0 AND size > 1 THEN greatest(((square - total * total / size) / (size - 1) - total / size) / pow(total / size, 2), 0) ELSE 0 END AS k FROM s)
SELECT station, {O.day('d')} AS date, round(avg(k), 6) AS k_mean, round(quantile_cont(k, 0.025), 6) AS k_low, round(quantile_cont(k, 0.975), 6) AS k_high FROM k GROUP BY ALL""",
)
def bootstrap_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    series = intensity.minute_series(intensity.minute_counts(tables.taps(spark, sf)))
    return rounded(dispersion.bootstrap_k(series).select("station", day("date").alias("date"), "k_mean", "k_low", "k_high"))


@query(
    "a26_binned_means",
    f"""WITH {O.minute_grid()} SELECT station, {O.day('d')} AS date, CAST((minute - 240) // 5 AS INT) AS bin, round(avg(lam), 6) AS mean_lambda, round(avg(n), 6) AS mean_count FROM grid GROUP BY ALL""",
)
def binned_means(spark: SparkSession, sf: str) -> DataFrame:
    table = intensity.binned_means(intensity.kernel_intensity(tables.taps(spark, sf)))
    return rounded(table.select("station", day("date").alias("date"), "bin", "mean_lambda", "mean_count"))


ACCURACY_SQL = """SELECT station, date_type, count(*) AS n, round(avg(abs(actual - predicted)), 6) AS mae,
 round(sqrt(avg(pow(actual - predicted, 2))), 6) AS rmse, round(100 * avg(abs(actual - predicted) / actual) FILTER (actual > 0), 6) AS mape,
 round(1 - sum(pow(actual - predicted, 2)) / nullif(sum(actual * actual) - sum(actual) * sum(actual) / count(*), 0), 6) AS r2
FROM pairs GROUP BY ALL"""


@query("a27_forecast_accuracy", f"WITH {O.count_facts(60)}, {HOLDOUT_SQL} {ACCURACY_SQL}")
def forecast_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["station", "date_type"]
    pairs = predicted_actual_raw(spark, sf)
    return rounded(curves.accuracy(pairs, keys))


def predicted_actual_raw(spark: SparkSession, sf: str) -> DataFrame:
    train, test = curves.holdout_split(_open_facts(spark, sf))
    mean = curves.average_curve(curves.dense_slots(train, ["count_in"]), ["count_in"], BIN)
    keys = ["station", "date_type", "time"]
    pairs = test.select(*keys, F.coalesce("count_in", F.lit(0)).alias("actual")).join(mean, keys)
    return pairs.withColumnRenamed("mean_count_in", "predicted")


@query(
    "a28_destination_shares",
    f"""WITH {O.trips()}, c AS (SELECT origin, destination, count(*) AS n FROM trips GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY origin), 6) AS p FROM c""",
)
def destination_shares(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trips.destination_shares(trips.trips(tables.taps(spark, sf))))


@query(
    "a29_destination_shares_by_window",
    f"""WITH {O.trips()}, c AS (SELECT {O.bucket(15, 't1')} AS w, origin, destination, count(*) AS n FROM trips GROUP BY ALL)
SELECT {O.stamp('w')} AS w, origin, destination, n, round(n / sum(n) OVER (PARTITION BY w, origin), 6) AS p FROM c""",
)
def destination_shares_by_window(spark: SparkSession, sf: str) -> DataFrame:
    found = trips.destination_shares_by_window(trips.trips(tables.taps(spark, sf)))
    return rounded(found.select(stamp("window").alias("w"), "origin", "destination", "n", "p"))


@query(
    "a30_curve_correlation",
    f"""WITH {O.curves(60, 10, 20)}, {PAIRS_SQL.format(label='day_of_week', where='')},
d AS (SELECT station, day_of_week AS label, count(DISTINCT (year, month, day)) AS n_days FROM z GROUP BY ALL)
SELECT p.station, label AS day_of_week, max(n_days) AS n_days, round(avg(r), 6) AS mean_corr, round(stddev_pop(r), 6) AS std_corr
FROM pr p JOIN d USING (station, label) GROUP BY ALL""",
)
def curve_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cluster.curve_correlation(aligned_curves(spark, sf), "day_of_week"))


@query(
    "a30_curve_correlation_fixed_type",
    f"""WITH {O.curves(60, 10, 20)}, {PAIRS_SQL.format(label='month', where="AND a.date_type = 'WD' AND b.date_type = 'WD'")}
SELECT station, label AS month, round(avg(r), 6) AS mean_corr, round(stddev_pop(r), 6) AS std_corr FROM pr GROUP BY ALL""",
)
def curve_correlation_fixed_type(spark: SparkSession, sf: str) -> DataFrame:
    found = cluster.curve_correlation(aligned_curves(spark, sf), "month", ("date_type", "WD"))
    return rounded(found.select("station", "month", "mean_corr", "std_corr"))


@query(
    "a32_two_tap_histogram",
    f"""WITH {CARD_DAYS_SQL}, e AS (SELECT min(minutes) AS lo, max(minutes) AS hi FROM two)
SELECT CAST(least(floor((minutes - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, count(*) AS n FROM two, e GROUP BY ALL""",
)
def two_tap_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return goodness.spanning_histogram(trips.two_tap_gaps(_card_days(spark, sf)), "minutes", 50)


@query(
    "a32_pit_histogram",
    f"""WITH {O.minute_grid()}, c AS (SELECT *, sum(lam) OVER (PARTITION BY station, d ORDER BY minute) AS comp FROM grid),
e AS (SELECT t.station, c.d, 1 - exp(-(comp - lag(comp) OVER (PARTITION BY t.station, c.d ORDER BY t.ts, t.event_id))) AS pit FROM taps t
 JOIN c ON c.station = t.station AND c.d = CAST(t.ts AS DATE) AND c.minute = hour(t.ts) * 60 + minute(t.ts) WHERE {O.OPEN})
SELECT station, CAST(least(floor(pit / 0.05e0), 19) AS INT) AS bin, count(*) AS n FROM e WHERE pit IS NOT NULL GROUP BY ALL""",
)
def pit_histogram(spark: SparkSession, sf: str) -> DataFrame:
    steps = intensity.compensator_increments(intensity.kernel_intensity(tables.taps(spark, sf)))
    bins = F.least(F.floor(F.col("pit") / 0.05), F.lit(19)).cast("int")
    return steps.groupBy("station", bins.alias("bin")).agg(F.sum("weight").alias("n"))


@query(
    "a33_arrivals_per_minute",
    f"WITH {O.TAPS} SELECT station, {O.stamp(O.bucket(1))} AS minute, count(*) AS n FROM taps WHERE {O.OPEN} GROUP BY ALL",
)
def arrivals_per_minute(spark: SparkSession, sf: str) -> DataFrame:
    inside = tables.taps(spark, sf).where(C.in_hours(C.hhmm("ts")))
    return rates.window_counts(inside, 1).select("station", stamp("w").alias("minute"), "n")


@query(
    "a34_adjusted_rand",
    f"""WITH {O.TAPS}, l AS (SELECT station AS a, CASE WHEN hour(ts) < 12 THEN station ELSE 's' || card % 7 END AS b FROM taps),
c AS (SELECT a, b, count(*) AS n FROM l GROUP BY ALL),
t AS (SELECT sum(n * (n - 1) / 2) AS joint, sum(n) AS size FROM c),
ra AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT a, sum(n) AS n FROM c GROUP BY a)),
rb AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT b, sum(n) AS n FROM c GROUP BY b))
SELECT CAST(size AS BIGINT) AS size, round((joint - x * y / (size * (size - 1) / 2)) / ((x + y) / 2 - x * y / (size * (size - 1) / 2)), 6) AS ari FROM t, ra, rb""",
)
def adjusted_rand(spark: SparkSession, sf: str) -> DataFrame:
    second = F.when(F.hour("ts") < 12, F.col("station")).otherwise(F.concat(F.lit("s"), F.col("card") % 7))
    labels = tables.taps(spark, sf).select(F.col("station").alias("a"), second.alias("b"))
    return rounded(cluster.adjusted_rand(labels, [], "a", "b"))


# --- windows -----------------------------------------------------------------------------------


@query(
    "w1_previous_tap",
    f"""WITH {O.TAPS} SELECT event_id, lag(station) OVER w AS previous, {O.stamp('lag(ts) OVER w', True)} AS previous_ts
FROM taps WINDOW w AS (PARTITION BY card ORDER BY ts, event_id)""",
)
def previous_tap(spark: SparkSession, sf: str) -> DataFrame:
    paired = split.previous_row(tables.taps(spark, sf), ["card"], ["ts", "event_id"], ["ts", "station"], "p")
    return paired.select("event_id", F.col("p.station").alias("previous"), stamp("p.ts", True).alias("previous_ts"))


@query(
    "w2_event_gaps",
    f"""WITH {O.TAPS} SELECT event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY station ORDER BY ts, event_id))) / 1e6, 6) AS gap_s FROM taps""",
)
def event_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(process.event_gaps(tables.taps(spark, sf), ["station"]).select("event_id", "gap_s"))


GRID_RUN = "OVER (PARTITION BY station, d ORDER BY minute)"


@query(
    "w3_running_totals",
    f"""WITH {O.minute_grid()} SELECT station, {O.day('d')} AS date, CAST(minute AS INT) AS minute, CAST(sum(n) {GRID_RUN} AS BIGINT) AS total, round(sum(lam) {GRID_RUN}, 6) AS compensator FROM grid""",
)
def running_totals(spark: SparkSession, sf: str) -> DataFrame:
    grid = intensity.compensated(intensity.kernel_intensity(tables.taps(spark, sf)))
    return rounded(grid.select("station", day("date").alias("date"), "minute", "total", "compensator"))


@query(
    "w4_martingale_residual",
    f"""WITH {O.minute_grid()} SELECT station, {O.day('d')} AS date, CAST(minute AS INT) AS minute, round(sum(n) {GRID_RUN} - sum(lam) {GRID_RUN}, 6) + 0e0 AS residual FROM grid""",
)
def martingale_residual(spark: SparkSession, sf: str) -> DataFrame:
    grid = intensity.compensated(intensity.kernel_intensity(tables.taps(spark, sf)))
    return rounded(grid.select("station", day("date").alias("date"), "minute", "residual"))


@query("w5_rolling_rate", f"WITH {O.rolling()} SELECT station, {O.stamp('w')} AS w, n, round(estimate, 6) AS estimate FROM est")
def rolling_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rates.rolling_rate(tables.taps(spark, sf)).select("station", stamp("w").alias("w"), "n", "estimate"))


@query(
    "w6_gap_batches",
    f"""WITH {O.TAPS}, g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY station ORDER BY ts, event_id)) AS gap FROM taps)
SELECT event_id, CAST(sum(CASE WHEN gap IS NULL OR gap > 600 * 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY ts, event_id) AS BIGINT) AS batch,
       gap IS NULL OR gap > 600 * 1000000 AS first FROM g""",
)
def gap_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches with a ten-minute gap, since the test events are minutes apart."""
    return trips.numbered_batches(tables.taps(spark, sf), 600.0).select("event_id", "batch", "first")


@query(
    "w7_average_ranks",
    f"""WITH r AS (SELECT o_orderpriority AS station, round(o_totalprice / 500) * 500 AS value FROM orders),
k AS (SELECT *, rank() OVER (PARTITION BY station ORDER BY value) AS rk, count(*) OVER (PARTITION BY station, value) AS n FROM r)
SELECT DISTINCT station, value, n, rk + (n - 1) / 2 AS avg_rank FROM k""",
)
def average_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks of order values to the nearest 500, which ties many of them."""
    rows = tables.order_values(spark, sf).withColumn("value", F.round(F.col("value") / 500) * 500)
    return ranktests.average_ranks(rows, ["station"], "value").select("station", "value", "n", "avg_rank")


@query(
    "w8_ecdf_quantiles",
    f"""WITH {O.TAPS}, h AS (SELECT station, exits, count(*) AS n FROM taps GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY station ORDER BY exits) AS upto, sum(n) OVER (PARTITION BY station) AS size FROM h),
p AS (SELECT *, (upto - n / 2) / size AS p FROM r)
SELECT station, exits, n, round(upto / size, 6) AS ecdf, round(p, 6) AS q_uniform, round(-ln(1 - p), 6) AS q_expon, round({O.normal_ppf('p')}, 6) AS q_normal FROM p""",
)
def ecdf_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(goodness.quantile_pairs(tables.taps(spark, sf), ["station"], "exits"))


@query(
    "w9_autocorrelation",
    f"""WITH {O.minute_series()}, b AS (SELECT station, d, minute // 5 AS slot, sum(n) AS x FROM series GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY station, d ORDER BY slot) AS i FROM b)
SELECT a.station, {O.day('a.d')} AS date, CAST(l AS INT) AS lag, CASE WHEN var_pop(a.x) > 0 AND var_pop(z.x) > 0 THEN round(corr(a.x, z.x), 6) + 0e0 END AS acf FROM r a, (SELECT unnest(range(1, 40)) AS l) JOIN r z
ON z.station = a.station AND z.d = a.d AND z.i = a.i - l GROUP BY ALL""",
)
def autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    """Autocorrelation of five-minute counts within each station-day at lags 1 to 39."""
    acf = goodness.shifted_correlation(_five_minute_series(spark, sf), ["station", "date"], ["slot"], "x", list(range(1, 40)))
    return rounded(acf.select("station", day("date").alias("date"), "lag", "acf"))


def _five_minute_series(spark: SparkSession, sf: str) -> DataFrame:
    series = intensity.minute_series(intensity.minute_counts(tables.taps(spark, sf)))
    return series.groupBy("station", "date", F.floor(F.col("minute") / 5).alias("slot")).agg(F.sum("n").alias("x"))


@query(
    "w10_decay_recursion",
    f"""WITH {O.TAPS}, e AS (SELECT station, CAST(ts AS DATE) AS d, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 60e0 AS t, event_id FROM taps WHERE {O.OPEN}),
z AS (SELECT *, t - min(t) OVER (PARTITION BY station, d) AS u FROM e),
s AS (SELECT station, d, b AS beta, t, event_id, exp(-b * u) * coalesce(sum(exp(b * u)) OVER (PARTITION BY station, d, b ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
      FROM z, (SELECT unnest([0.01e0, 0.05e0, 0.1e0]) AS b))
SELECT station, {O.day('d')} AS date, beta, round(arg_max(s, (t, event_id)), 6) AS s_last, round(sum(s), 6) AS s_total FROM s GROUP BY ALL""",
)
def decay_recursion(spark: SparkSession, sf: str) -> DataFrame:
    sums = hawkes.decay_sums(tables.taps(spark, sf), [0.01, 0.05, 0.1])
    return rounded(sums.select("station", day("date").alias("date"), "beta", "s_last", "s_total"))


DENSITY_SQL = f"""{O.TAPS}, e AS (SELECT *, CAST(ts AS DATE) AS d FROM taps WHERE {O.OPEN}),
f AS (SELECT event_id, station, d, ts, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY station, d))) // 1000000 AS sec,
             (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY station, d))) / 1e6 AS exact FROM e),
nb AS (SELECT *, count(*) OVER (PARTITION BY station, d ORDER BY sec RANGE BETWEEN 900 PRECEDING AND 900 FOLLOWING) AS nb FROM f),
co AS (SELECT *, CASE WHEN nb >= 3 THEN sec END AS core FROM nb),
pn AS (SELECT *, max(core) OVER (PARTITION BY station, d ORDER BY sec RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
              min(core) OVER (PARTITION BY station, d ORDER BY sec RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM co),
op AS (SELECT DISTINCT station, d, sec FROM pn WHERE core IS NOT NULL AND (prev IS NULL OR sec - prev > 900)),
lb AS (SELECT p.*, (SELECT count(*) FROM op o WHERE o.station = p.station AND o.d = p.d AND o.sec <= p.sec) - 1 AS run FROM pn p),
cl AS (SELECT *, CAST(CASE WHEN core IS NOT NULL OR sec - prev <= 900 THEN run WHEN next - sec <= 900 THEN run + 1 ELSE -1 END AS INT) AS cluster FROM lb)"""
EPS, MIN_SAMPLES = 900, 3


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Density clusters with a radius of 15 minutes, since the test events are minutes apart."""
    return density.clusters(density.arrival_seconds(tables.taps(spark, sf)), EPS, MIN_SAMPLES)


@query(
    "w11_cluster_bounds",
    f"""WITH {DENSITY_SQL} SELECT station, {O.day('d')} AS date, cluster, {O.stamp('min(ts)', True)} AS first, {O.stamp('max(ts)', True)} AS last FROM cl GROUP BY ALL""",
)
def cluster_bounds(spark: SparkSession, sf: str) -> DataFrame:
    found = density.cluster_summary(_labelled(spark, sf))
    return found.select("station", day("date").alias("date"), "cluster", stamp("start", True).alias("first"), stamp("end", True).alias("last"))


@query(
    "w12_neighbour_counts",
    f"""WITH {DENSITY_SQL} SELECT DISTINCT station, {O.day('d')} AS date, sec, nb AS neighbours FROM nb""",
)
def neighbour_counts(spark: SparkSession, sf: str) -> DataFrame:
    near = density.neighbours(density.arrival_seconds(tables.taps(spark, sf)), EPS)
    return near.select("station", day("date").alias("date"), "sec", "neighbours")


@query(
    "a31_cluster_summary",
    f"""WITH {DENSITY_SQL} SELECT station, {O.day('d')} AS date, cluster, count(*) AS size, round(avg(exact), 4) AS mean_s FROM cl GROUP BY ALL""",
)
def cluster_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = density.cluster_summary(_labelled(spark, sf))
    return rounded(found.select("station", day("date").alias("date"), "cluster", "size", "mean_s"), 4)


@query(
    "m17_density_clusters",
    f"""WITH {DENSITY_SQL} SELECT station, {O.day('d')} AS date, sec, count(*) AS n, cluster FROM cl GROUP BY ALL""",
)
def density_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).select("station", day("date").alias("date"), "sec", "n", "cluster")


# --- ordering, sampling, sets ------------------------------------------------------------------


@query(
    "l1_leaderboard",
    f"""WITH {O.ticks(30)}, r AS (SELECT tick, station, round(estimate, 2) AS estimate FROM sampled)
SELECT {O.stamp('tick')} AS tick, station, estimate, CAST(row_number() OVER (PARTITION BY tick ORDER BY estimate DESC, station) AS INT) AS place
FROM r QUALIFY place <= 3""",
)
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return rates.leaderboard(tables.taps(spark, sf)).select(stamp("tick").alias("tick"), "station", "estimate", "place")


@query(
    "l2_multi_key_order",
    f"WITH {O.count_facts(15)} SELECT date_type, station, {O.stamp('w')} AS w, count_in FROM facts ORDER BY date_type, count_in DESC, station, w",
)
def multi_key_order(spark: SparkSession, sf: str) -> DataFrame:
    facts = rates.count_facts(tables.taps(spark, sf)).orderBy("date_type", F.desc("count_in"), "station", "window")
    return facts.select("date_type", "station", stamp("window").alias("w"), "count_in")


@query(
    "l3_first_windows",
    f"WITH {OVER_SQL} SELECT station, {O.stamp('w')} AS w, round(mean, 6) AS mean, count FROM o ORDER BY w, station LIMIT 20",
)
def first_windows(spark: SparkSession, sf: str) -> DataFrame:
    """First twenty windows of the overdispersion report."""
    table = rates.overdispersion(tables.taps(spark, sf)).orderBy("window", "station").limit(20)
    return rounded(table.select("station", stamp("window").alias("w"), "mean", "count"))


@query(
    "l4_stratified_days",
    f"""WITH RECURSIVE {O.holidays('orders', 'o_orderdate')},
cal AS (SELECT CAST(unnest(generate_series((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 DAY)) AS DATE) AS d),
t AS (SELECT d, {O.day_type('d')} AS date_type FROM cal),
s AS (SELECT *, CASE WHEN date_type IN ('SA', 'SU') THEN 'weekend' ELSE date_type END AS stratum,
             md5({O.day('d')} || '|42') AS draw, md5({O.day('d')} || '|43') AS spare FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY year(d), month(d), stratum ORDER BY draw) AS k,
             row_number() OVER (PARTITION BY year(d), month(d), stratum ORDER BY spare) AS k2,
             bool_or(stratum = 'weekend') OVER (PARTITION BY year(d), month(d)) AS weekend FROM s)
SELECT {O.day('d')} AS date, date_type FROM r WHERE k <= 2 OR (NOT weekend AND stratum = 'WD' AND k2 = 1)""",
)
def stratified_days(spark: SparkSession, sf: str) -> DataFrame:
    days = sampling.days_between(tables.order_values(spark, sf), "ts")
    return sampling.stratified_days(days).select(day("date").alias("date"), "date_type")


@query(
    "u1_stacked_results",
    f"""WITH {O.count_facts(15)} {" UNION ALL ".join(f"SELECT date_type, station, count(*) AS windows, CAST(sum(count_in) AS BIGINT) AS taps FROM facts WHERE date_type = '{t}' GROUP BY ALL" for t in ('WD', 'SA', 'SU', 'HO'))}""",
)
def stacked_results(spark: SparkSession, sf: str) -> DataFrame:
    """Per-type results stacked; grouping by the type gives the same rows in one pass over the facts."""
    facts = rates.count_facts(tables.taps(spark, sf))
    return facts.groupBy("date_type", "station").agg(F.count(F.lit(1)).alias("windows"), F.sum("count_in").alias("taps"))


@query(
    "u2_in_out_union",
    f"WITH {O.count_facts(15)} SELECT station, {O.stamp('w')} AS w, count_in, count_out FROM facts",
)
def in_out_union(spark: SparkSession, sf: str) -> DataFrame:
    """Check-in and check-out measures stacked on one key and merged."""
    taps = tables.taps(spark, sf)
    stacked = rates.counts_in(taps).unionByName(rates.counts_out(taps), allowMissingColumns=True)
    merged = stacked.groupBy("station", "window").agg(F.max("count_in").alias("count_in"), F.max("count_out").alias("count_out"))
    return merged.select("station", stamp("window").alias("w"), "count_in", "count_out")


@query(
    "u3_distinct_slots",
    f"WITH {O.count_facts(15)} SELECT station, time FROM facts WHERE date_type = 'WD' UNION SELECT station, time FROM facts WHERE date_type = 'HO'",
)
def distinct_slots(spark: SparkSession, sf: str) -> DataFrame:
    facts = rates.count_facts(tables.taps(spark, sf)).select("station", "time", "date_type")
    working, holiday = (facts.where(F.col("date_type") == t).select("station", "time") for t in ("WD", "HO"))
    return working.union(holiday).distinct()

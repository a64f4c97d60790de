"""Streaming queries. Each runs over the whole event table, closes all windows at its end, and equals its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemeter.operators import trips
from tidemeter.plans import oracle as O
from tidemeter.plans.registry import query, rounded, stamp
from tidemeter.plans.storage import write_daily_csv
from tidemeter.session import scratch_path
from tidemeter.sources import tables
from tidemeter.streaming import flows, replay
from tidemeter.streaming import ingest as stream_ingest

CLOSED_SQL = f"""{O.TAPS}, closed AS (SELECT station, {O.bucket(5)} AS w, count(*) AS n FROM taps GROUP BY ALL),
est AS (SELECT station, {O.day('w')} AS date, w, n, avg(n) OVER p AS estimate, lead(w) OVER (PARTITION BY station, CAST(w AS DATE) ORDER BY w) AS next_w
        FROM closed WINDOW p AS (PARTITION BY station, CAST(w AS DATE) ORDER BY w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""


def _ticks_sql(minutes: int) -> str:
    width = f"INTERVAL '{minutes} minutes'"
    return f"""{CLOSED_SQL},
first AS (SELECT *, CASE WHEN time_bucket({width}, w) = w THEN w ELSE time_bucket({width}, w) + {width} END AS first FROM est WHERE next_w IS NOT NULL),
ticks AS (SELECT station, estimate, unnest(generate_series(first, next_w - INTERVAL 1 SECOND, {width})) AS tick FROM first WHERE first < next_w)"""


def _counts(spark: SparkSession, sf: str, end: str) -> DataFrame:
    return flows.tumbling_counts(flows.event_stream(flows.stream_session(spark), sf, end=end))


def _replayed(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the event table as the batches of a replay in slices of a day took them, with the number of the batch."""
    stream = replay.replay_stream(flows.stream_session(spark), f"{sf}/events.parquet", "event_id bigint, ts timestamp_ntz, event_type string, value double")
    taps = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("station"), F.col("value").alias("exits"))
    path = flows.run_slices(spark, taps, "replay", flows.keep_batch)
    return spark.read.schema("ts timestamp, station string, exits double, batch int").parquet(f"{path}/rows")


@query("s14_replay_counts", f"WITH {O.TAPS} SELECT station, count(*) AS n, round(sum(exits), 4) AS exits FROM taps GROUP BY station")
def replay_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The event table replayed as a stream in order of time, then counted."""
    return rounded(_replayed(spark, sf).groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.sum("exits").alias("exits")), 4)


@query(
    "s14_replay_slices",
    f"""WITH {O.TAPS}, s AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n, min(ts) AS first, max(ts) AS last FROM taps GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY d) AS INT) AS place, n, {O.stamp('first', True)} AS first, {O.stamp('last', True)} AS last FROM s""",
)
def replay_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Each batch of the replay is one day, and the days rise with the batches."""
    batches = _replayed(spark, sf).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    place = F.row_number().over(Window.orderBy("batch"))  # one row a day
    return batches.select(place.alias("place"), "n", stamp("first", True).alias("first"), stamp("last", True).alias("last"))


@query("r1_tumbling_counts", f"WITH {CLOSED_SQL} SELECT station, {O.stamp('w')} AS w, n FROM closed")
def tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    end = flows.known_end(spark)
    rows = flows.run_to_files(spark, _counts(spark, sf, end), "tumbling")
    return rows.select("station", stamp("w").alias("w"), "n")


@query("r2_rolling_rates", f"WITH {CLOSED_SQL} SELECT station, {O.stamp('w')} AS w, n, round(estimate, 6) AS estimate FROM est")
def rolling_rates(spark: SparkSession, sf: str) -> DataFrame:
    end = flows.known_end(spark)
    rows = flows.run_to_files(spark, flows.rolling_rates(_counts(spark, sf, end)), "rolling")
    return rounded(rows.select("station", stamp("w").alias("w"), "n", "estimate"))


@query("r3_sampled_rates", f"WITH {_ticks_sql(15)} SELECT station, {O.stamp('tick')} AS tick, round(estimate, 6) AS estimate FROM ticks")
def sampled_rates(spark: SparkSession, sf: str) -> DataFrame:
    end = flows.known_end(spark)
    rows = flows.run_to_files(spark, flows.rolling_rates(_counts(spark, sf, end), tick_minutes=15), "sampled")
    return rounded(rows.select("station", stamp("w").alias("tick"), "estimate"))


@query(
    "r4_leaderboard",
    f"""WITH {_ticks_sql(30)}, r AS (SELECT tick, station, round(estimate, 2) AS estimate FROM ticks)
SELECT {O.stamp('tick')} AS tick, station, estimate, CAST(row_number() OVER (PARTITION BY tick ORDER BY estimate DESC, station) AS INT) AS place FROM r QUALIFY place <= 3""",
)
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    end = flows.known_end(spark)
    ticks = flows.rolling_rates(_counts(spark, sf, end), tick_minutes=30)
    path = flows.run_batches(spark, ticks, "leaderboard", flows.keep_leaderboard)
    return flows.read_leaderboard(spark, path).select(stamp("w").alias("tick"), "station", "estimate", "place")


@query("r5_trip_stream", f"WITH {O.trips()} SELECT card, origin, destination, {O.stamp('t1', True)} AS t1, {O.stamp('t2', True)} AS t2 FROM trips WHERE t2 - t1 <= INTERVAL 72 HOUR")
def trip_stream(spark: SparkSession, sf: str) -> DataFrame:
    end = flows.known_end(spark)
    stream = flows.stream_trips(flows.event_stream(flows.stream_session(spark), sf, end=end))
    rows = flows.run_to_files(spark, stream, "trips")
    return rows.select("card", "origin", "destination", stamp("t1", True).alias("t1"), stamp("t2", True).alias("t2"))


def _live_sql(minutes: int) -> str:
    width = "INTERVAL '15 minutes'"
    return f"""{O.trips()}, s AS (SELECT origin, destination, CASE WHEN time_bucket({width}, t2) = t2 THEN t2 ELSE time_bucket({width}, t2) + {width} END AS a,
  time_bucket({width}, t1 + INTERVAL '{minutes} minutes') AS b FROM trips),
k AS (SELECT origin, destination, unnest(generate_series(a, b, {width})) AS tick FROM s WHERE a <= b),
c AS (SELECT tick, origin, destination, count(*) AS n FROM k GROUP BY ALL)
SELECT {O.stamp('tick')} AS tick, origin, destination, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY tick, origin), 6) AS p FROM c"""


@query("r6_rolling_shares", f"WITH {_live_sql(15)}")
def rolling_shares(spark: SparkSession, sf: str) -> DataFrame:
    found = trips.rolling_shares(trips.trips(tables.taps(spark, sf)))
    return rounded(found.select(stamp("tick").alias("tick"), "origin", "destination", "n", "p"))


@query("r6_rolling_shares_stream", f"WITH {_live_sql(15)}")
def rolling_shares_stream(spark: SparkSession, sf: str) -> DataFrame:
    end = flows.known_end(spark)
    stream = flows.stream_trips(flows.event_stream(flows.stream_session(spark), sf, end=end))
    path = flows.run_batches(spark, stream, "shares", flows.keep_rolling_shares)
    found = flows.read_rolling_shares(spark, path)
    return rounded(found.select(stamp("tick").alias("tick"), "origin", "destination", "n", "p"))


@query(
    "r7_bursts",
    f"""WITH {O.TAPS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY station ORDER BY ts, event_id) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS o FROM taps),
b AS (SELECT *, sum(o) OVER (PARTITION BY station ORDER BY ts, event_id) AS batch FROM g),
s AS (SELECT station, batch, min(ts) AS first, max(ts) AS last, count(*) AS n FROM b GROUP BY ALL)
SELECT station, {O.stamp('first', True)} AS first, n FROM s""",
)
def bursts(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts with a ten-minute gap, since the test events are minutes apart."""
    end = flows.known_end(spark)
    stream = flows.bursts(flows.event_stream(flows.stream_session(spark), sf, end=end), "10 minutes")
    return flows.run_to_files(spark, stream, "bursts").select("station", stamp("first", True).alias("first"), "n")


@query(
    "r8_incremental_ingest",
    f"""WITH {O.count_facts(15)}, code AS (SELECT DISTINCT station, trim(replace(split_part(station_field, ')', 1), '(', '')) AS code FROM taps)
SELECT code, year, month, day, day_of_week, time, date_type, count_in, count_out, round(variance_in_1min, 6) AS variance_in_1min FROM facts JOIN code USING (station)""",
)
def incremental_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """CSV files written from the events, several for each day, ingested as a stream into dimension, facts and ledger.

    Files arrive a dozen a trigger, so days are spread over triggers; a second call finds nothing new.
    """
    source, folder = scratch_path(spark, "daily-csv"), stream_ingest.scratch_store(spark)
    write_daily_csv(tables.taps(spark, sf).repartition(3, "event_id"), source)
    stream_ingest.ingest_stream(spark, source, folder, files_per_trigger=36)
    store = stream_ingest.ingest_stream(spark, source, folder)
    named = store.facts.join(store.stations.withColumnRenamed("id", "station_id"), "station_id")
    columns = ["code", "year", "month", "day", "day_of_week", "time", "date_type", "count_in", "count_out", "variance_in_1min"]
    return rounded(named.select(*columns))


@query(
    "r9_two_flow_replay",
    f"""WITH {O.TAPS}, f AS (SELECT 'in' AS flow, station, ts FROM taps UNION ALL SELECT 'out', station, ts FROM taps WHERE exits >= 50),
k AS (SELECT flow, station, {O.bucket(5)} AS w, count(*) AS n FROM f GROUP BY ALL)
SELECT flow, station, {O.stamp('w')} AS w, n, round(avg(n) OVER (PARTITION BY flow, station, CAST(w AS DATE) ORDER BY w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS estimate FROM k""",
)
def two_flow_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Check-ins and check-outs as two sources in one stream; check-outs are the events of at least 50."""
    session = flows.stream_session(spark)
    end = flows.known_end(spark)
    entering = flows.event_stream(session, sf, end=end).select(F.lit("in").alias("flow"), "station", "ts")
    leaving = flows.event_stream(session, sf, end=end).where("exits >= 50").select(F.lit("out").alias("flow"), "station", "ts")
    counts = flows.tumbling_counts(entering.union(leaving), keys=["flow", "station"])
    rows = flows.run_to_files(spark, flows.rolling_rates(counts, ["flow", "station"]), "two-flow")
    return rounded(rows.select("flow", "station", stamp("w").alias("w"), "n", "estimate"))

"""Scans, sinks, dimension, ledger and fact-table queries."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemeter.functions import columns as C
from tidemeter.operators import rates
from tidemeter.plans import oracle as O
from tidemeter.plans.registry import day, query, rounded, stamp
from tidemeter.session import scratch_path
from tidemeter.session import stored as written
from tidemeter.sources import facts as facts_io
from tidemeter.sources import ingest
from tidemeter.sources import ledger as ledger_io
from tidemeter.sources import stations as stations_io
from tidemeter.sources import tables

SELECTED_DATES = ["20240105", "20240106", "20240108", "20240117"]
LEDGER_PROCESS = "daily_check_ins_counts_15min"


def header_files(rows: DataFrame, names: dict[str, str]) -> str:
    """Text rows as CSV files under the headers of the daily files, which stand the other way round on odd days; returns the folder.

    ``rows`` has the columns that ``names`` maps headers to, and ``odd``.
    """
    path = scratch_path(rows.sparkSession, "headers")
    columns = [F.col(c).alias(header) for header, c in names.items()]
    rows.where(~F.col("odd")).select(*columns).write.option("header", True).csv(f"{path}/even")
    rows.where("odd").select(*columns[::-1], F.lit("x").alias("Linea")).write.option("header", True).csv(f"{path}/odd")
    return path


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    odd = (F.dayofmonth("ts") % 2 == 1).alias("odd")
    return tables.taps(spark, sf).select(
        stamp("ts", True).alias("ts"), day("ts").alias("date"), F.date_format("ts", "HH:mm:ss").alias("time"), "station_field", "card", "exits", odd
    )


@query("s1_checkin_scan", f"WITH {O.TAPS} SELECT {O.stamp('ts', True)} AS ts, station_field FROM taps")
def checkin_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Check-ins written as daily files in two orders of columns and read back by their headers."""
    back = tables.read_checkin_files(spark, header_files(_texts(spark, sf), tables.CHECKIN_COLUMNS))
    return back.select(stamp("ts", True).alias("ts"), "station_field")


@query("s1_synthetic_scan", f"WITH {O.TAPS} SELECT {O.day('ts')} AS date, station_field, count(*) AS n FROM taps GROUP BY ALL")
def synthetic_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The same for the files of simulated validations, counted by day and station."""
    back = tables.read_synthetic_files(spark, header_files(_texts(spark, sf), tables.SYNTHETIC_COLUMNS))
    return back.groupBy(day("ts").alias("date"), "station_field").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s2_checkout_scan",
    f"""WITH {O.TAPS}, raw AS (SELECT {O.day('ts')} AS date, strftime(ts, '%H:%M:%S') AS time, station_field, exits FROM taps)
SELECT {O.stamp("CAST(date || ' ' || time AS TIMESTAMP)")} AS ts, station_field, exits FROM raw""",
)
def checkout_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Check-outs written as daily files in two orders of columns and read back by their headers."""
    back = tables.read_checkout_files(spark, header_files(_texts(spark, sf), tables.CHECKOUT_COLUMNS))
    return back.select(stamp("ts").alias("ts"), "station_field", "exits")


@query("s3_card_scan", f"WITH {O.TAPS} SELECT {O.stamp('ts', True)} AS ts, station, card FROM taps")
def card_scan(spark: SparkSession, sf: str) -> DataFrame:
    return tables.taps(spark, sf).select(stamp("ts", True).alias("ts"), "station", "card")


@query(
    "s4_daily_files",
    f"""WITH {O.TAPS}, f AS (SELECT strftime(ts, '%Y%m%d') AS file_id, * FROM taps)
SELECT file_id, count(*) AS n FROM f WHERE file_id IN ({", ".join(f"'{d}'" for d in SELECTED_DATES)}) GROUP BY file_id""",
)
def daily_files(spark: SparkSession, sf: str) -> DataFrame:
    # Conditions on the stored time column reach the scan; the day names of what is left are then compared.
    days = [F.to_timestamp_ntz(F.lit(d), F.lit("yyyyMMdd")) for d in SELECTED_DATES]
    within = reduce(or_, [(F.col("ts") >= d) & (F.col("ts") < d + F.expr("INTERVAL 1 DAY")) for d in days])
    dated = tables.events(spark, sf).where(within).select(F.date_format("ts", "yyyyMMdd").alias("file_id"))
    return tables.select_files(dated, SELECTED_DATES).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


def _files(taps: DataFrame) -> DataFrame:
    return taps.select(
        F.date_format("ts", "yyyyMMdd").alias("filename"), F.lit(LEDGER_PROCESS).alias("process_type")
    ).distinct()


def _ledger(taps: DataFrame) -> DataFrame:
    """A ledger in mid-week state: Monday to Thursday files done, Friday files registered, weekend files unknown."""
    weekday = F.weekday(F.to_date("filename", "yyyyMMdd"))
    return _files(taps).where(weekday <= 4).select(
        "filename", "process_type", (weekday <= 3).alias("processed"),
        F.lit(None).cast("timestamp").alias("processed_at"), F.lit(None).cast("timestamp").alias("created_at"),
    )


FILES_SQL = f"""files AS (SELECT DISTINCT strftime(ts, '%Y%m%d') AS filename, '{LEDGER_PROCESS}' AS process_type, isodow(ts) AS wd FROM events),
ledger AS (SELECT filename, process_type, wd <= 4 AS processed FROM files WHERE wd <= 5)"""


@query(
    "s5_unprocessed_files",
    f"""WITH {FILES_SQL} SELECT f.filename, f.process_type FROM files f
WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.filename = f.filename AND l.process_type = f.process_type AND l.processed)""",
)
def unprocessed_files(spark: SparkSession, sf: str) -> DataFrame:
    taps = tables.taps(spark, sf)
    return ledger_io.unprocessed(_files(taps), _ledger(taps)).select("filename", "process_type")


@query(
    "s6_ledger_upkeep",
    f"""WITH {FILES_SQL},
marked AS (SELECT f.filename, f.process_type,
                  coalesce(l.processed, FALSE) OR isodow(CAST(strptime(f.filename, '%Y%m%d') AS DATE)) = 7 AS processed
           FROM files f LEFT JOIN ledger l USING (filename, process_type))
SELECT filename, process_type, processed FROM marked WHERE filename <> '20240102'""",
)
def ledger_upkeep(spark: SparkSession, sf: str) -> DataFrame:
    """Register every file, mark the Sunday files as processed, delete one file's records."""
    taps = tables.taps(spark, sf)
    files = _files(taps)
    registered = ledger_io.get_or_create(_ledger(taps), files)
    sundays = files.where(F.weekday(F.to_date("filename", "yyyyMMdd")) == 6)
    kept = ledger_io.delete(ledger_io.mark_processed(registered, sundays), "20240102")
    return kept.select("filename", "process_type", "processed")


STATIONS_SQL = f"""{O.TAPS},
members AS (SELECT DISTINCT trim(replace(split_part(station_field, ')', 1), '(', '')) AS code,
                   trim(split_part(station_field, ')', 2)) AS name FROM taps),
stations AS (SELECT CAST(row_number() OVER (ORDER BY code) AS INT) AS id, code, name FROM members)"""


def station_dimension(taps: DataFrame) -> DataFrame:
    empty = taps.sparkSession.createDataFrame([], "id int, code string, name string")
    return stations_io.insert_members(empty, stations_io.members(taps))


@query(
    "s7_station_lookup",
    f"""WITH {STATIONS_SQL}
SELECT 'code' AS lookup, id, code, name FROM stations WHERE code IN ('09905', '11804')
UNION ALL SELECT 'id', id, code, name FROM stations WHERE id = 2
UNION ALL SELECT 'all', id, code, name FROM stations""",
)
def station_lookup(spark: SparkSession, sf: str) -> DataFrame:
    stations = station_dimension(tables.taps(spark, sf))
    found = {
        "code": stations_io.by_code(stations, "09905", "11804"),
        "id": stations_io.by_id(stations, 2),
        "all": stations,
    }
    tagged = [df.select(F.lit(tag).alias("lookup"), "id", "code", "name") for tag, df in found.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query(
    "s8_new_stations",
    f"""WITH {STATIONS_SQL},
old AS (SELECT CAST(row_number() OVER (ORDER BY code) AS INT) AS id, code, name FROM members WHERE name < 'p')
SELECT * FROM old
UNION ALL
SELECT CAST((SELECT max(id) FROM old) + row_number() OVER (ORDER BY code) AS INT), code, name
FROM members WHERE code NOT IN (SELECT code FROM old)""",
)
def new_stations(spark: SparkSession, sf: str) -> DataFrame:
    taps = tables.taps(spark, sf)
    return stations_io.insert_members(station_dimension(taps.where("station < 'p'")), stations_io.members(taps))


FACT_KEYS = rates.FACT_KEYS


@query(
    "s9_fact_upsert",
    f"""WITH {O.count_facts(15)},
first AS (SELECT * FROM facts WHERE time < 1500), second AS (SELECT * FROM facts WHERE time >= 900)
SELECT {", ".join(FACT_KEYS)}, coalesce(s.count_in, f.count_in) AS count_in, coalesce(s.count_out, f.count_out) AS count_out,
 round(coalesce(s.variance_in_1min, f.variance_in_1min), 6) AS variance_in_1min FROM first f FULL JOIN second s USING ({", ".join(FACT_KEYS)})""",
)
def fact_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """All facts in two halves of the day that overlap from 09:00 to 15:00; the union is the whole table."""
    facts = written(rates.count_facts(tables.taps(spark, sf), 15), "facts")
    merged = facts_io.upsert(facts.where("time < 1500"), facts.where("time >= 900"), FACT_KEYS, facts_io.COUNT_MEASURES)
    return rounded(merged.select(*FACT_KEYS, "count_in", "count_out", "variance_in_1min"))


POINT = {"station": "click", "year": 2024, "month": 1, "day": 9}


@query(
    "s10_fact_point_update",
    f"""WITH {O.count_facts(15)}
SELECT {", ".join(FACT_KEYS)},
       CASE WHEN station = 'click' AND year = 2024 AND month = 1 AND day = 9 THEN 7 ELSE count_in END AS count_in, count_out,
       round(CASE WHEN station = 'click' AND year = 2024 AND month = 1 AND day = 9 THEN 0.5 ELSE variance_in_1min END, 6) AS variance_in_1min
FROM facts""",
)
def fact_point_update(spark: SparkSession, sf: str) -> DataFrame:
    facts = rates.count_facts(tables.taps(spark, sf))
    changed = facts_io.update(facts, {"count_in": 7, "count_out": None}, **POINT)
    changed = facts_io.update(changed, {"variance_in_1min": 0.5}, **POINT)
    return rounded(changed.select(*FACT_KEYS, "count_in", "count_out", "variance_in_1min"))


@query(
    "s11_fact_scan",
    f"""WITH {O.count_facts(15)} SELECT {", ".join(FACT_KEYS)}, count_in FROM facts
WHERE station IN ('click', 'view', 'purchase') AND time BETWEEN 400 AND 2300""",
)
def fact_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Facts written by month and read back with pushed-down station and time predicates."""
    path = scratch_path(spark, "facts")
    facts = rates.count_facts(tables.taps(spark, sf))
    facts_io.write(facts.select(*FACT_KEYS, "count_in"), path, station="station")
    stored = facts_io.read(spark, path)
    return facts_io.scan(stored, ["click", "view", "purchase"], station="station").select(*FACT_KEYS, "count_in")


@query(
    "s12_ordered_fact_scan",
    f"""WITH {O.count_facts(15)} SELECT station, {O.stamp('w')} AS w, date_type, count_in, count_out FROM facts
WHERE date_type = 'WD' AND time BETWEEN 400 AND 2300 ORDER BY station, year, month, day, time""",
)
def ordered_fact_scan(spark: SparkSession, sf: str) -> DataFrame:
    facts = rates.count_facts(tables.taps(spark, sf)).where("date_type = 'WD' AND time BETWEEN 400 AND 2300")
    return facts_io.ordered(facts, "station").select("station", stamp("window").alias("w"), "date_type", "count_in", "count_out")


def write_daily_csv(taps: DataFrame, path: str) -> None:
    """Event rows as CSV, one folder per day."""
    (
        taps.select("event_id", stamp("ts", True).alias("ts"), "station_field", "card", "exits", F.to_date("ts").alias("date"))
        .write.mode("overwrite").option("header", True).partitionBy("date").csv(path)
    )


CSV_SCHEMA = "event_id bigint, ts timestamp, station_field string, card bigint, exits double, date date"


@query(
    "s13_daily_csv_sink",
    f"""WITH {O.TAPS} SELECT {O.day('ts')} AS date, station_field, count(*) AS n, round(sum(exits), 4) AS exits FROM taps GROUP BY ALL""",
)
def daily_csv_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "daily-csv")
    write_daily_csv(tables.taps(spark, sf), path)
    back = spark.read.schema(CSV_SCHEMA).option("header", True).csv(path)
    return rounded(
        back.groupBy(day("date").alias("date"), "station_field").agg(F.count(F.lit(1)).alias("n"), F.sum("exits").alias("exits")), 4
    )


@query(
    "s8_rate_ingest",
    f"""WITH {O.rate_facts(15)}, code AS (SELECT DISTINCT station, trim(replace(split_part(station_field, ')', 1), '(', '')) AS code FROM taps)
SELECT code, {", ".join(FACT_KEYS[1:])}, round(lambda_in, 6) AS estimated_lambda_in, round(lambda_out, 6) AS estimated_lambda_out FROM rates JOIN code USING (station)""",
)
def rate_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Daily check-in and check-out files, read by their headers, ingested into a table of rates; the check-ins come twice."""
    texts = _texts(spark, sf)
    ins = written(tables.read_checkin_files(spark, header_files(texts, tables.CHECKIN_COLUMNS)), "check-ins")
    outs = written(tables.read_checkout_files(spark, header_files(texts, tables.CHECKOUT_COLUMNS)), "check-outs")
    store, rates_table = ingest.empty_store(spark), ingest.empty_rates(spark)
    for rows, process_type in ((ins, ingest.ESTIMATES_IN), (outs, ingest.ESTIMATES_OUT), (ins, ingest.ESTIMATES_IN)):
        store, rates_table = ingest.ingest_rates(store, rates_table, rows, process_type)
        store.stations, store.ledger, store.minutes = (written(part, "rate-store") for part in (store.stations, store.ledger, store.minutes))
        rates_table = written(rates_table, "rates")
    named = rates_table.join(store.stations.withColumnRenamed("id", "station_id"), "station_id")
    return rounded(named.select("code", *FACT_KEYS[1:], *facts_io.RATE_MEASURES))

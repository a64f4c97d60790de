"""Streams over several triggers against their batch twins."""

import pytest
from pyspark.sql import functions as F

from tidemeter.operators import rates, trips
from tidemeter.sources import tables
from tidemeter.streaming import flows
from tidemeter.streaming import ingest as stream_ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The event table in five files, in time order, one per trigger."""
    folder = tmp_path_factory.mktemp("events")
    tables.events(spark, SF).repartitionByRange(5, "ts").sortWithinPartitions("ts").write.mode("overwrite").parquet(str(folder / "e"))
    return str(folder / "e")


def stream(spark, parts, end=None):
    import os
    import time

    for i, name in enumerate(sorted(n for n in os.listdir(parts) if n.startswith("part"))):
        os.utime(f"{parts}/{name}", (time.time() - 100 + i, time.time() - 100 + i))
    return flows.event_stream(flows.stream_session(spark), parts, "*.parquet", files_per_trigger=1, end=end)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_rolling_rates_over_triggers(spark, parts):
    end = flows.open_end(spark)
    got = flows.run_to_files(spark, flows.rolling_rates(flows.tumbling_counts(stream(spark, parts, end))), "t-rolling", end=end)
    twin = rates.rolling_rate(tables.taps(spark, SF))
    assert rows(got, "station", "w", "n", "estimate") == rows(twin, "station", "w", "n", "estimate")


def test_trips_over_triggers(spark, parts):
    end = flows.open_end(spark)
    got = flows.run_to_files(spark, flows.stream_trips(stream(spark, parts, end)), "t-trips", end=end)
    twin = trips.trips(tables.taps(spark, SF)).where(F.col("t2") - F.col("t1") <= F.expr("INTERVAL 72 HOURS"))
    assert rows(got, "card", "origin", "destination", "t1", "t2") == rows(twin, "card", "origin", "destination", "t1", "t2")


def test_trips_of_rows_that_cross_triggers_out_of_order(spark, tmp_path):
    day = "2024-01-02 08:{:02d}:00"
    files = [[("A", 0), ("C", 4)], [("B", 2), ("C", 6)]]
    for n, taps in enumerate(files):
        made = [(n * 10 + i, day.format(m), 1, s, 1.0, None) for i, (s, m) in enumerate(taps)]
        frame = spark.createDataFrame(made, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
        frame.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    end = flows.open_end(spark)
    got = flows.run_to_files(spark, flows.stream_trips(stream(spark, str(tmp_path / "e"), end)), "t-order", end=end)
    found = sorted((r.origin, r.destination, r.t1.minute, r.t2.minute) for r in got.collect())
    assert found == [("A", "B", 0, 2), ("B", "C", 2, 4)]


def test_event_table_as_a_folder_of_files(spark, tmp_path):
    tables.events(spark, SF).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    taps = flows.event_stream(flows.stream_session(spark), str(tmp_path), files_per_trigger=1).select("station")
    assert flows.run_to_files(spark, taps, "t-folder").count() == tables.events(spark, SF).count()


def test_ingest_over_triggers_equals_one_pass(spark, tmp_path):
    source = str(tmp_path / "csv")
    taps = tables.taps(spark, SF).where("ts < '2024-01-05'")
    (
        taps.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "station_field", "card", "exits", F.to_date("ts").alias("date"))
        .repartition("date").write.option("header", True).partitionBy("date").csv(source)
    )
    store = stream_ingest.ingest_stream(spark, source, str(tmp_path / "store"), files_per_trigger=2)
    assert store.ledger.where("processed").count() == 8
    want = rates.count_facts(taps)
    assert store.facts.count() == want.count()
    assert store.facts.agg(F.sum("count_in"), F.sum("count_out")).first() == want.agg(F.sum("count_in"), F.sum("count_out")).first()
    assert store.facts.groupBy("station_id", "year", "month", "day", "time").count().where("count > 1").isEmpty()


def test_ingest_of_several_files_a_day_a_late_file_and_a_restart(spark, tmp_path):
    source, folder = str(tmp_path / "csv"), str(tmp_path / "store")
    taps = tables.taps(spark, SF).where("ts < '2024-01-03'")
    dated = taps.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "station_field", "card", "exits", F.to_date("ts").alias("date"))
    dated.where("event_id % 4 > 0").repartition(3, "event_id").write.option("header", True).partitionBy("date").csv(source)
    stream_ingest.ingest_stream(spark, source, folder, files_per_trigger=1)
    dated.where("event_id % 4 = 0").coalesce(1).write.mode("append").option("header", True).partitionBy("date").csv(source)
    stream_ingest.ingest_stream(spark, source, folder, files_per_trigger=1)
    store = stream_ingest.ingest_stream(spark, source, folder)
    key = ["year", "month", "day", "time"]
    measures = ["count_in", "count_out", F.round("variance_in_1min", 9).alias("v")]
    code = F.regexp_extract("station_field", r"\((\d+)\)", 1).alias("code")
    codes = taps.select("station", code).distinct()
    got = store.facts.join(store.stations.withColumnRenamed("id", "station_id"), "station_id").select("code", *key, *measures)
    want = rates.count_facts(taps).join(codes, "station").select("code", *key, *measures)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


class FakeState:
    """A list or value state that counts the rows it is given."""

    def __init__(self):
        self.rows, self.given = [], 0

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows, self.given = list(rows), self.given + len(rows)

    def appendList(self, rows):
        self.put([*self.rows, *rows])

    def exists(self):
        return bool(self.rows)

    def clear(self):
        self.rows = []


class FakeValue(FakeState):
    def get(self):
        return self.rows[0] if self.rows else None

    def update(self, value):
        self.rows = [value]


class FakeHandle:
    def __init__(self):
        self.timers, self.value, self.list = [], FakeValue(), FakeState()

    def getValueState(self, name, schema):
        return self.value

    def getListState(self, name, schema):
        return self.list

    def registerTimer(self, at):
        self.timers.append(at)


class FakeClock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_taps_of_a_frame_are_one_row_of_state_and_cards_without_trips_no_frame():
    import pandas as pd

    handle, seen = FakeHandle(), flows.LastSeen()
    seen.init(handle)
    frame = pd.DataFrame({"ts": pd.to_datetime([3, 1, 2], unit="s"), "event_id": [3, 1, 2], "station": ["b", "a", "a"]})
    assert list(seen.handleInputRows((7,), iter([frame]), None)) == [] and handle.list.given == 1 and handle.timers == [1001]
    assert list(seen.handleExpiredTimer((7,), FakeClock(2000), None)) == []  # two taps at one station, one tap still held
    (trip,) = [r for f in seen.handleExpiredTimer((7,), FakeClock(10**12), None) for r in f.itertuples(index=False)]
    assert trip[:3] == (7, "a", "b") and (trip.t1, trip.t2) == (pd.Timestamp(2, unit="s"), pd.Timestamp(3, unit="s"))
    assert not handle.list.rows and not handle.value.rows

"""Streaming forms of the rate, trip and ingest operators.

Event time is the tap time. Every stream has a watermark, so windows close and state is released; a
batch twin in ``tidemeter.operators`` gives the same rows once the windows are closed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemeter.operators import trips as trip_ops
from tidemeter.session import scratch_path, use_utc
from tidemeter.sources.tables import EVENT_SCHEMA, raw_field

DELAY = "10 minutes"
HOUR_MS = 3_600_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application for stateful queries.

    State partitions are fixed for the life of a query, so they are a setting: the session's shuffle
    partitions. State lives in RocksDB, off the heap.
    """
    session = use_utc(spark.newSession())
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return session


def read_stream(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files_per_trigger: int | None = None, glob: str | None = None
) -> DataFrame:
    """File stream in arrival order; the checkpoint remembers which files are done."""
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


#: The end mark: a row of no station, later than any tap and within the range of nanosecond clocks.
END_MARK = [(-1, datetime(2200, 1, 1), -1, "", 1e9, None)]


def open_end(spark: SparkSession) -> str:
    """A folder that will hold the end mark of a stream once its input is complete."""
    path = scratch_path(spark, "end")
    spark.createDataFrame([], EVENT_SCHEMA).write.parquet(path)
    return path


def close_end(spark: SparkSession, end: str) -> None:
    spark.createDataFrame(END_MARK, EVENT_SCHEMA).write.mode("append").parquet(end)


def known_end(spark: SparkSession) -> str:
    """A folder that holds the end mark already, for a stream that takes its whole input in one batch.

    The watermark follows the mark after that batch, and the batch without data that ends the run closes all windows.
    """
    path = open_end(spark)
    close_end(spark, path)
    return path


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def event_stream(
    spark: SparkSession, folder: str, glob: str | None = None, files_per_trigger: int | None = None, end: str | None = None
) -> DataFrame:
    """The event table as a tap stream with watermark, whether it is one file or a folder of files.

    ``glob`` names other files of ``folder`` instead of the event table. ``end`` is a folder of ``open_end``.
    """
    path = folder
    if glob is None:
        table = f"{folder}/events.parquet"
        path, glob = (table, None) if is_folder(spark, table) else (folder, "events.parquet")
    raw = read_stream(spark, path, EVENT_SCHEMA, files_per_trigger=files_per_trigger, glob=glob)
    if end:
        raw = raw.unionByName(read_stream(spark, end, EVENT_SCHEMA))
    taps = raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("card"),
        F.col("event_type").alias("station"),
        raw_field().alias("station_field"),
        F.col("value").alias("exits"),
    )
    return taps.withWatermark("ts", DELAY)


def tumbling_counts(taps: DataFrame, minutes: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Closed windows: keys, start ``w``, count ``n``, and ``closed``, their event time for the operators that follow."""
    keys = keys or ["station"]
    counted = taps.groupBy(F.window("ts", f"{minutes} minutes").alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, F.col("window.start").alias("w"), "n", F.window_time("window").alias("closed"))


def bursts(taps: DataFrame, gap: str = "5 seconds") -> DataFrame:
    """First tap and size of every burst; a gap of exactly the limit keeps a burst together."""
    sessions = taps.groupBy(F.session_window("ts", gap).alias("session"), "station").agg(
        F.min("ts").alias("first"), F.count(F.lit(1)).alias("n")
    )
    return sessions.select("station", "first", "n")


class RollingRate(StatefulProcessor):
    """Mean of the latest counts of a key; optionally the ticks that each estimate covers.

    A key is one station (and flow) on one day. State is at most ``last`` counts and the previous
    window, whatever the traffic, and a timer releases it once the watermark has passed the day.
    """

    def __init__(self, key_names: list[str], last: int = 3, tick_minutes: int | None = None):
        self.key_names, self.last, self.tick_minutes = key_names, last, tick_minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "n bigint")
        self.previous = handle.getValueState("previous", "w timestamp, estimate double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("w")
        held = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        before = self.previous.get() if self.previous.exists() else None
        out = []
        for w, n in zip(batch["w"], batch["n"]):
            if self.tick_minutes and before is not None:
                tick = pd.Timestamp(before[0]).ceil(f"{self.tick_minutes}min")
                while tick < w:
                    out.append((tick, 0, before[1]))
                    tick += pd.Timedelta(minutes=self.tick_minutes)
            held = [*held, int(n)][-self.last :]
            before = (pd.Timestamp(w).to_pydatetime(), sum(held) / len(held))
            if not self.tick_minutes:
                out.append((w, int(n), before[1]))
        self.recent.put([(n,) for n in held])
        if not self.previous.exists():
            day_end = pd.Timestamp(before[0]).normalize() + pd.Timedelta(days=1)
            self.handle.registerTimer(day_end.value // 1_000_000)
        self.previous.update(before)
        frame = pd.DataFrame(out, columns=["w", "n", "estimate"])
        yield frame.assign(**dict(zip(self.key_names, key)))[[*self.key_names, "w", "n", "estimate"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        self.previous.clear()
        return iter(())

    def close(self) -> None:
        pass


def rolling_rates(counts: DataFrame, keys: list[str] | None = None, last: int = 3, tick_minutes: int | None = None) -> DataFrame:
    """Estimates per closed window, or per tick when ``tick_minutes`` is given."""
    keys = [*(keys or ["station"]), "date"]
    types = {"date": "string"}
    fields = ", ".join(f"{k} {types.get(k, 'string')}" for k in keys)
    dated = counts.withColumn("date", F.date_format("w", "yyyy-MM-dd"))
    return dated.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=RollingRate(keys, last, tick_minutes),
        outputStructType=f"{fields}, w timestamp, n bigint, estimate double",
        outputMode="append",
        timeMode="EventTime",
    )


class LastSeen(StatefulProcessor):
    """Previous tap of a card; a change of station within ``hours`` emits a trip.

    Taps wait in state until the watermark has passed them and are then taken in order of event time, so rows that
    cross triggers out of order give the same trips as the batch form. State is what the watermark holds back of a
    card and its last tap, which a timer releases after the retention.
    """

    def __init__(self, hours: int = 72):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "us bigint, station string")
        # One row a frame, as every row that goes to or from the state costs a call.
        self.pending = handle.getListState("pending", "us array<bigint>, event_id array<bigint>, station array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, first = [], None
        for frame in rows:
            us = frame["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
            held.append((us, frame["event_id"].tolist(), frame["station"].tolist()))
            first = min(us) if first is None else min(first, *us)
        if held:
            self.pending.appendList(held)
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tap for part in self.pending.get() for tap in zip(*part)]
        due = sorted((r for r in held if r[0] <= passed), key=lambda r: r[:2])
        rest = [r for r in held if r[0] > passed]
        known = self.seen.get()
        before = None if known is None else tuple(known)
        keep = self.hours * HOUR_MS * 1000
        trips = []
        for us, _, station in due:
            if before is not None and before[1] != station and us - before[0] <= keep:
                trips.append((before[1], station, before[0], us))
            before = (us, station)
        if rest:
            self.pending.put([tuple(map(list, zip(*rest)))])
            self.handle.registerTimer(min(r[0] for r in rest) // 1000 + 1)
        elif held:
            self.pending.clear()
        if before is not None and (rest or before[0] + keep > passed):
            self.seen.update(before)
            if not rest:
                self.handle.registerTimer((before[0] + keep) // 1000 + 1)
        elif known is not None:
            self.seen.clear()
        if trips:
            origin, destination, t1, t2 = zip(*trips)
            moments = (np.array(t, "datetime64[us]") for t in (t1, t2))
            yield pd.DataFrame(dict(zip(("card", "origin", "destination", "t1", "t2"), (key[0], origin, destination, *moments))))

    def close(self) -> None:
        pass


def stream_trips(taps: DataFrame, hours: int = 72) -> DataFrame:
    return (
        taps.where("card IS NOT NULL AND station IS NOT NULL")
        .select("card", "ts", "station", "event_id")
        .groupBy("card")
        .transformWithStateInPandas(
            statefulProcessor=LastSeen(hours),
            outputStructType="card bigint, origin string, destination string, t1 timestamp, t2 timestamp",
            outputMode="append",
            timeMode="EventTime",
        )
    )


# --- running streams ---------------------------------------------------------------------------


def _finish(writer: DataStreamWriter, spark: SparkSession, end: str | None) -> None:
    """Take everything available; then, if the input is complete, the end mark, which closes all windows."""
    writer.trigger(availableNow=True).start().awaitTermination()
    if end:
        close_end(spark, end)
        writer.trigger(availableNow=True).start().awaitTermination()


def run_to_files(spark: SparkSession, stream: DataFrame, label: str, mode: str = "append", end: str | None = None) -> DataFrame:
    """Run a stream over everything available into files of the shared folder and read them back."""
    path = scratch_path(spark, label)
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
    _finish(writer, spark, end)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def run_batches(
    spark: SparkSession, stream: DataFrame, label: str, handle: Callable[[DataFrame, int, str], None], end: str | None = None
) -> str:
    """Run a stream through ``handle(batch, id, path)``; returns the path. A repeated batch id must overwrite itself."""
    path = scratch_path(spark, label)
    writer = (
        stream.writeStream.outputMode("append")
        .foreachBatch(lambda batch, i: handle(batch, i, path))
        .option("checkpointLocation", f"{path}/checkpoint")
    )
    _finish(writer, spark, end)
    return path


def run_slices(spark: SparkSession, stream: DataFrame, label: str, handle: Callable[[DataFrame, int, str], None]) -> str:
    """Run a stream of a replay batch after batch until its source has no further slice; returns the path."""
    path = scratch_path(spark, label)
    writer = stream.writeStream.outputMode("append").foreachBatch(lambda batch, i: handle(batch, i, path))
    query = writer.option("checkpointLocation", f"{path}/checkpoint").trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return path


def keep_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Store the rows of a batch under its number."""
    batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")


def keep_leaderboard(batch: DataFrame, batch_id: int, path: str, top: int = 3) -> None:
    """Store the ticks of a batch and rank those ticks again over all their stations.

    Both writes replace the batch's own folder, so a repeated batch changes nothing. Ticks are stored by day, and
    only the days of a batch are read again.
    """
    session = batch.sparkSession
    batch.withColumn("day", F.to_date("w")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/ticks/batch={batch_id}")
    touched = batch.select(F.to_date("w").alias("day"), "w").distinct()
    schema = "station string, date string, w timestamp, n bigint, estimate double, batch int, day date"
    stored = session.read.schema(schema).parquet(f"{path}/ticks")
    known = stored.where(F.col("batch") <= batch_id).join(touched, ["day", "w"], "left_semi")
    rated = known.withColumn("estimate", F.round("estimate", 2))
    place = F.row_number().over(_by_tick())
    ranked = rated.withColumn("place", place).where(F.col("place") <= top).select("w", "station", "estimate", "place")
    ranked.write.mode("overwrite").parquet(f"{path}/board/batch={batch_id}")


def _by_tick():
    return Window.partitionBy("w").orderBy(F.desc("estimate"), "station")


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """Latest ranking of every tick."""
    rows = spark.read.schema("w timestamp, station string, estimate double, place int, batch int").parquet(f"{path}/board")
    latest = rows.groupBy("w").agg(F.max("batch").alias("batch"))
    return rows.join(latest, ["w", "batch"], "left_semi").drop("batch")


def keep_rolling_shares(batch: DataFrame, batch_id: int, path: str, minutes: int = 15) -> None:
    """Store how many live trips a batch adds to every tick; totals over batches give the shares."""
    counted = trip_ops.rolling_shares(batch, minutes).select("tick", "origin", "destination", "n")
    counted.write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")


def read_rolling_shares(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("tick timestamp, origin string, destination string, n bigint").parquet(f"{path}/counts")
    total = rows.groupBy("tick", "origin", "destination").agg(F.sum("n").alias("n"))
    return trip_ops.shares(total, ["tick"])

"""A streaming source that replays an event table in order of time.

Its offsets are the starts of slices of event time, so a day arrives slice after slice however its rows are spread over
files; the table may be one file or a folder. Each micro-batch takes the next slice; rows are read from the files by
the time range, which prunes row groups, one partition a file. A query that restarts goes on from its last slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

EPOCH = datetime(1970, 1, 1)


@dataclass
class FileSlice(InputPartition):
    path: str
    start: str
    end: str


class ReplayReader(DataSourceStreamReader):
    """Offsets are ``{"from": time}``: everything before that time has been taken."""

    def __init__(self, options: dict[str, str], columns: list[str]):
        self.root, self.time, self.columns = options["path"], options.get("time", "ts"), columns
        self.width = timedelta(seconds=int(options.get("slice_seconds", "86400")))
        self.taken: datetime | None = None

    def _dataset(self, path: str | None = None):
        import pyarrow.dataset as ds
        from pyarrow import fs

        remote = "://" in self.root or self.root.startswith("file:")
        system, root = fs.FileSystem.from_uri(self.root) if remote else (fs.LocalFileSystem(), self.root)
        return ds.dataset(path or root, filesystem=system, format="parquet")

    def _span(self) -> tuple[datetime, datetime]:
        """Start of the first slice, and the end of the last, from the statistics of the files' row groups."""
        low, high = [], []
        for fragment in self._dataset().get_fragments():
            for group in fragment.row_groups:
                held = (group.statistics or {}).get(self.time)
                if held:
                    low.append(held["min"])
                    high.append(held["max"])
        if not low:
            return EPOCH, EPOCH
        first = EPOCH + (min(low) - EPOCH) // self.width * self.width
        return first, EPOCH + ((max(high) - EPOCH) // self.width + 1) * self.width

    def initialOffset(self) -> dict:
        return {"from": self._span()[0].isoformat()}

    def latestOffset(self) -> dict:
        """One slice further at each call, until the end of the table."""
        if self.taken is None:
            self.first, self.last = self._span()
            self.taken = self.first
        self.taken = min(self.taken + self.width, self.last)
        return {"from": self.taken.isoformat()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.taken is None or self.taken.isoformat() < end["from"]:  # a restarted query plans its last batch first
            self.first, self.last = self._span()
            self.taken = datetime.fromisoformat(end["from"])
        return [FileSlice(f.path, start["from"], end["from"]) for f in self._dataset().get_fragments()] if start != end else []

    def read(self, partition: FileSlice) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        data = self._dataset(partition.path)
        kind = data.schema.field(self.time).type
        low, high = (pa.scalar(datetime.fromisoformat(t), kind) for t in (partition.start, partition.end))
        inside = (ds.field(self.time) >= low) & (ds.field(self.time) < high)
        target = pa.schema([data.schema.field(c) for c in self.columns]).set(self.columns.index(self.time), pa.field(self.time, pa.timestamp("us")))
        for batch in data.to_batches(columns=self.columns, filter=inside):
            if batch.num_rows:
                yield batch.cast(target)

    def commit(self, end: dict) -> None:
        pass


class Replay(DataSource):
    """Options: ``path`` of a Parquet table, ``time`` (its timestamp column, ``ts``), ``slice_seconds`` (a day)."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self):
        raise ValueError("name the columns to replay with .schema(...)")

    def streamReader(self, schema) -> ReplayReader:
        return ReplayReader(dict(self.options), schema.fieldNames())


def replay_stream(spark: SparkSession, path: str, schema, slice_seconds: int = 86_400, time: str = "ts") -> DataFrame:
    spark.dataSource.register(Replay)
    return spark.readStream.format("replay").schema(schema).option("slice_seconds", str(slice_seconds)).option("time", time).load(path)

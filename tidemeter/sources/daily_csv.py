"""A data source of daily CSV files whose columns may stand in another order in every file.

Each file is one partition and is read by its own header, block by block, so a wanted column is found by its name. All
values arrive as text with the name of their file; a file that lacks a column is an error that names it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

BLOCK_BYTES = 8 << 20


@dataclass
class OneFile(InputPartition):
    path: str


class DailyCsvReader(DataSourceReader):
    def __init__(self, root: str, names: dict[str, str]):
        self.root, self.names = root, names

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = self._system()
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        hidden = lambda p: any(part.startswith(("_", ".")) for part in p[len(path) :].strip("/").split("/"))
        return [OneFile(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(".csv") and not hidden(f.path)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        from pyarrow import csv

        system, _ = self._system()
        file_id = partition.path.rsplit("/", 1)[-1].removesuffix(".csv")
        texts = csv.ConvertOptions(include_columns=list(self.names), column_types=dict.fromkeys(self.names, pa.string()), strings_can_be_null=True, null_values=[""])
        with system.open_input_stream(partition.path) as stream:
            try:
                blocks = csv.open_csv(stream, csv.ReadOptions(block_size=BLOCK_BYTES), csv.ParseOptions(newlines_in_values=True), texts)
            except pa.lib.ArrowKeyError as missing:
                raise ValueError(f"{partition.path}: {missing}") from missing
            for block in blocks:
                columns = [*block.columns, pa.array([file_id] * block.num_rows, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*self.names.values(), "file_id"])


class DailyCsv(DataSource):
    """Options: ``path``, a folder whose CSV files are read, and ``names``, a JSON object of wanted header names and their columns."""

    @classmethod
    def name(cls) -> str:
        return "daily_csv"

    def _names(self) -> dict[str, str]:
        return json.loads(self.options["names"])

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in (*self._names().values(), "file_id")])

    def reader(self, schema: StructType) -> DailyCsvReader:
        return DailyCsvReader(self.options["path"], self._names())


def read_daily_csv(spark: SparkSession, path: str, names: dict[str, str], types: dict[str, str]) -> DataFrame:
    """Columns of all files below ``path`` by header name, cast to ``types`` where given, with ``file_id``."""
    spark.dataSource.register(DailyCsv)
    raw = spark.read.format("daily_csv").option("names", json.dumps(names)).load(path)
    return raw.select(*[F.col(c).cast(types.get(c, "string")).alias(c) for c in names.values()], "file_id")

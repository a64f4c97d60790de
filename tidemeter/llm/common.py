"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word patterns: space, tab, line feed, vertical tab, form feed, carriage return. These are
#: also the bytes at which ``bytes.split`` cuts.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A supplied table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = own.get() if own.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="tidemeter-llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame written below the shared folder and read again, which cuts its lineage."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo five; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit keys over all bits (the finaliser of a published generator)."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """One key for every run of ``size`` word keys."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    keys = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return mix(keys)


class Remembered(dict):
    """Values made on first use. When ``most`` are held they step back, and those used again return: memory stays bounded."""

    def __init__(self, make, most: int = 300_000):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def keep(self, values: dict) -> None:
        """Takes in values that were made elsewhere."""
        for key, value in values.items():
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[key] = value


class WordKeys:
    """64-bit keys of words, remembered for the words met lately."""

    def __init__(self, most: int = 200_000):
        import xxhash

        self.key = Remembered(xxhash.xxh3_64_intdigest, most).__getitem__

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.key, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Words between white space with A-Z lower-cased; other letters stay as they are."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, for choosing how many parts to cut them into."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0)).cast("long")).first()[0]


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the smallest node that each can reach by them."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = places[: len(a)], places[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        least = np.minimum(label[a], label[b])
        for side in (a, b):
            np.minimum.at(label, label[side], least)
        while (label[label] != label).any():
            label = label[label]
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
    return nodes, nodes[label]


def stars(edges: DataFrame) -> DataFrame:
    """The edges of every task as one star for each component that they form; the graph's components stay."""

    def contract(batches):
        import pyarrow as pa

        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if not held:
            return
        nodes, low = least_labels(*(np.concatenate(side) for side in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[nodes != low]), pa.array(low[nodes != low])], ["a", "b"])

    return edges.select("a", "b").mapInArrow(contract, "a long, b long")


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) of every node in the undirected ``edges`` (a, b), longs; the component is its smallest node.

    Every task first contracts the edges of its files to stars. Then two joins alternate until nothing changes: every
    node sends the smallest node of its neighbourhood to its larger neighbours, then to its smaller ones. Each round is a
    written table. Edges to a node of many neighbours are aggregated before they meet.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), label)
    edges = stored(stars(edges).distinct(), label)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        edges = stored(stars(stored(small, label)), label)
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def matrix_of(column, width: int) -> np.ndarray:
    """Rows of an Arrow list column as a matrix, shorter rows filled up with zeros."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), values.dtype)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def valid_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector as doubles), one row per id: no null vectors, no null, infinite or NaN components, no null ids.

    Of several rows with one id, the smallest vector in array order stays.
    """
    doubles = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col(id_column).cast("long").alias("vec_id"), doubles.alias("vector"))
        .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
    )

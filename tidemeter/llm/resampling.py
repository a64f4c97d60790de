"""Resampling of documents towards a target collection, by importance weights and exact ranks.

Every document is scored by the mean gain of its word runs, hashed to buckets, plus noise fixed by its id. The
highest scores are drawn. Their ranks come from a parallel sort by regular sampling: every task sorts its run of
scores and gives regular samples, the samples give splitters, the rows of a segment meet and are put in order
there, and the counts of the segments before give exact ranks.

Only the columns of id and text are read, so others may have any name. A null text has no words. A null id
counts as the empty text for the noise and comes last among equal scores. Repeated rows are documents of their
own, with ranks that follow one another. Without documents, or without any that is long enough, nothing is drawn;
without a target every bucket has the target count 0. Texts of any length are taken whole.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.llm.common import stored

#: Bytes as the words see them: A-Z lower-cased, digits, letters and all bytes of other characters kept, the rest a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Features of a task are counted whenever so many are held.
HELD = 1_000_000
#: Samples that the driver sorts are at most so many.
MOST_SAMPLES = 1_000_000


def run_buckets(text: bytes | None, buckets: int, longest: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of one to ``longest`` words. A run's crc32 continues that of its beginning."""
    words = (text or b"").translate(WORD_BYTES).split()
    ends = [b" " + w for w in words[1:]]
    runs = list(map(crc32, words))
    found = [np.array(runs, np.uint32)]
    for more in range(1, longest):
        runs = list(map(crc32, ends[more - 1 :], runs))
        found.append(np.array(runs, np.uint32))
    return len(words), np.concatenate(found) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, column: str, buckets: int, longest: int) -> np.ndarray:
    """Number of features in every bucket; each task sends one row for each bucket that it met."""

    def count(batches):
        counts, held, size = np.zeros(buckets, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(run_buckets(text.as_py(), buckets, longest)[1])
                size += len(held[-1])
                if size >= HELD:
                    counts += np.bincount(np.concatenate(held), minlength=buckets)
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(met, pa.int32()), "n": pa.array(counts[met], pa.int64())})

    parts = texts.select(F.col(column).cast("binary").alias("text")).mapInArrow(count, "bucket int, n long")
    counts = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of smoothed shares, one for each bucket."""
    size, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: float(t + 1) * float(s_all + size) / (float(s + 1) * float(t_all + size))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def scored(docs: DataFrame, gains: np.ndarray, longest: int, seed: int, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    buckets = len(gains)

    def weigh(batches):
        for batch in batches:
            words, features, weights = [], [], []
            for text in batch.column(1):
                n, found = run_buckets(text.as_py(), buckets, longest)
                words.append(n)
                features.append(len(found))
                weights.append(int(gains[found].sum()) // len(found) if len(found) else 0)
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (words, features, weights))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    schema = "doc_id long, n_words long, n_features long, weight long"
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("text")).mapInArrow(weigh, schema)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + noise)


def _order(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, -scores))


def _columns(batch) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids, missing ids last."""
    ids = batch.column("doc_id").fill_null(np.iinfo(np.int64).max)
    return batch.column("score").to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)


def splitters(rows: DataFrame, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids that cut the rows, highest score first, into about equal segments.

    A task sorts its rows and sends regular samples, each for an equal number of them. A segment then holds at most
    N / segments + N / samples of a task rows more than one task's step, whatever the order of the rows was.
    """
    runs = max(1, rows.rdd.getNumPartitions())
    each = max(16, min(segments, MOST_SAMPLES // runs))

    def sample(batches):
        held = [_columns(batch) for batch in batches]
        scores, ids = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (np.empty(0, np.int64),) * 2
        order = _order(scores, ids)
        taken = order[np.arange(each) * len(order) // each] if len(order) else order
        weight = np.full(len(taken), len(order) / each)
        yield pa.RecordBatch.from_arrays([pa.array(scores[taken]), pa.array(ids[taken]), pa.array(weight)], ["score", "doc_id", "weight"])

    found = rows.mapInArrow(sample, "score long, doc_id long, weight double").toPandas()
    scores, ids = found["score"].to_numpy(np.int64), found["doc_id"].to_numpy(np.int64)
    order = _order(scores, ids)
    share = np.cumsum(found["weight"].to_numpy()[order])
    if not len(order):
        return scores, ids
    at = np.searchsorted(share, share[-1] * np.arange(1, segments) / segments, side="right")
    cut = np.unique(np.minimum(at, len(order) - 1))
    return scores[order][cut], ids[order][cut]


def segment_of(scores: np.ndarray, ids: np.ndarray, cut_scores: np.ndarray, cut_ids: np.ndarray) -> np.ndarray:
    """Number of splitters that are not behind each row, by binary search on score and id together."""
    low, high = np.zeros(len(scores), np.int64), np.full(len(scores), len(cut_scores), np.int64)
    while (open_ := low < high).any():
        middle = np.where(open_, (low + high) // 2, 0)
        ahead = (cut_scores[middle] > scores) | ((cut_scores[middle] == scores) & (cut_ids[middle] <= ids))
        low, high = np.where(open_ & ahead, middle + 1, low), np.where(open_ & ~ahead, middle, high)
    return low


def ranked(rows: DataFrame, draw: int, segments: int) -> DataFrame:
    """The rows with their exact rank by falling score and rising doc_id; null behind the first ``draw``.

    Segments wholly behind the last drawn row are not moved at all.
    """
    cut_scores, cut_ids = splitters(rows.select("score", "doc_id"), segments)

    def place(batches):
        for batch in batches:
            found = segment_of(*_columns(batch), cut_scores, cut_ids) if len(cut_scores) else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*batch.schema.names, "segment"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = stored(rows.mapInArrow(place, f"{fields}, segment int"), "resampling-placed")
    sizes = dict(placed.groupBy("segment").count().collect())
    before, offsets = 0, []
    for segment in sorted(sizes):
        offsets.append((segment, before))
        before += sizes[segment]
    drawn = [o for o in offsets if o[1] < draw]
    last = drawn[-1][0] if drawn else -1
    starts = F.broadcast(rows.sparkSession.createDataFrame(drawn, "segment int, before long"))  # at most one row a segment
    inside = Window.partitionBy("segment").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    rank = F.row_number().over(inside) + F.col("before")
    front = placed.where(F.col("segment") <= last).join(starts, "segment").withColumn("rank", rank)
    front = front.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).drop("before")
    behind = placed.where(F.col("segment") > last).withColumn("rank", F.lit(None).cast("long"))
    return front.unionByName(behind).drop("segment")


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    buckets: int = 10_000,
    longest: int = 2,
    least_words: int = 20,
    percent: int = 25,
    seed: int = 7,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; rank is null for those not drawn."""
    gains = bucket_gains(bucket_counts(docs, text_column, buckets, longest), bucket_counts(target, text_column, buckets, longest))
    rows = stored(scored(docs, gains, longest, seed, id_column, text_column), "resampling-scored")
    able = F.col("n_words") >= least_words
    draw = rows.where(able).count() * percent // 100
    segments = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = rows.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked(rows.where(able), draw, segments).unionByName(short)

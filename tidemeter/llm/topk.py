"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are documents, dimensions their terms. Documents are put in ranges of one order (dominant dimension, then
id) and cut into blocks. A block keeps the maximum and minimum of every dimension and a forward index, the matrix
of its documents. For a query, the summed maxima of its terms bound every score in a block; blocks are visited in
falling order of that bound and scored through their forward index until a bound is below the k-th score so far.

Spark deals ranges of blocks (shards) and batches of queries out to tasks. A query starts with the k-th score
it reaches in its own shard, so most blocks of other shards need no scoring where vectors form groups.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.llm.common import matrix_of, stored, valid_vectors

SHARD = "kind string, shard int, block int, ids binary, data binary, high binary, low binary, kth binary"


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """Vectors with every component x replaced by floor(scale * x)."""
    valid = valid_vectors(vectors, id_column, vector_column)
    return valid.select("vec_id", F.transform("vector", lambda x: F.floor(x * F.lit(float(scale)))).alias("vector"))


def _safe(a: np.ndarray, b: np.ndarray, rows: int) -> bool:
    """Whether inner products of whole numbers, times the block length, are exact in doubles."""
    most = [float(np.abs(x).max(initial=0)) for x in (a, b)]
    return most[0] * most[1] * max(1, a.shape[1]) * (rows + 1) < 2.0**52


def search_blocks(queries, query_ids, blocks, kth, k: int):
    """Top k of every query over ``blocks`` (ids ascending, matrix, high, low): scores and ids, -1 where too few.

    ``kth`` holds scores already reached: blocks whose bound lies below them are left out.
    """
    n = len(query_ids)
    lowest = np.iinfo(np.int64).min
    best = np.full((n, k), lowest, np.int64)
    best_ids = np.full((n, k), -1, np.int64)
    if not n or not blocks:
        return best, best_ids
    kth = kth.copy()
    high = np.stack([b[2] for b in blocks]).astype(np.float64)
    low = np.stack([b[3] for b in blocks]).astype(np.float64)
    as_double = queries.astype(np.float64)
    bound = np.maximum(as_double, 0) @ high.T + np.minimum(as_double, 0) @ low.T
    slack = np.abs(bound) * 1e-12 + 1e-6
    order = np.argsort(-bound, axis=1, kind="stable")
    for step in range(len(blocks)):
        at = order[:, step]
        rows = np.arange(n)
        live = rows[bound[rows, at] + slack[rows, at] >= kth]
        if not len(live):
            break
        for b in np.unique(at[live]):
            ids, data = blocks[b][0], blocks[b][1]
            own = live[at[live] == b]
            m = len(ids)
            exact = _safe(queries[own], data, m)
            kind = np.float64 if exact else np.int64
            score = queries[own].astype(kind) @ data.T.astype(kind)
            score = score.astype(np.int64)
            self_match = query_ids[own][:, None] == ids[None, :]
            score[self_match] = lowest
            take = min(k, m)
            if exact:
                keyed = np.where(self_match, lowest, score * m + (m - 1 - np.arange(m)))
                top = np.argpartition(-keyed.astype(np.float64), take - 1, axis=1)[:, :take]
            else:
                top = np.lexsort((np.broadcast_to(ids, score.shape), ~score), axis=-1)[:, :take]
            found, found_ids = np.take_along_axis(score, top, 1), ids[top]
            found_ids = np.where(found == lowest, -1, found_ids)
            found, found_ids = np.hstack([best[own], found]), np.hstack([best_ids[own], found_ids])
            rank = np.lexsort((found_ids, ~found), axis=-1)[:, :k]
            best[own], best_ids[own] = np.take_along_axis(found, rank, 1), np.take_along_axis(found_ids, rank, 1)
            full = best_ids[own, -1] >= 0
            kth[own[full]] = np.maximum(kth[own[full]], best[own[full], -1].astype(np.float64))
    return best, best_ids


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: float = 256.0,
    block_rows: int = 256,
    shard_rows: int = 8192,
    query_rows: int = 65536,
) -> DataFrame:
    """The k largest inner products of every query row with all other rows: query_id, rank, vec_id, score.

    ``is_query`` is a condition on ``vec_id``. Components are floor(scale * x). Ties go to the smaller id. Rows with
    a null id, a null vector or a null or non-finite component take no part; vectors of different length are
    compared over the positions they share; an empty vector scores 0 with all. Of several rows with one id, one
    stays. An empty table gives no rows. Scores beyond 64 bits are outside the contract.
    """
    frame = quantised(vectors, id_column, vector_column, scale)
    known = frame.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    rows, width = known[0], max(1, known[1])
    shards = max(1, math.ceil(rows / shard_rows))
    # The dominant dimension groups documents whose large components agree, which tightens the bounds.
    largest = F.array_max(
        F.transform("vector", lambda x, i: F.struct(F.abs(x).alias("size"), i.alias("dim"), (x >= 0).alias("up")))
    )
    ordered = frame.select("vec_id", "vector", is_query.alias("asks"), (largest["dim"] * 2 + largest["up"].cast("int")).alias("dominant"))
    ordered = ordered.repartitionByRange(shards, "dominant", "vec_id").sortWithinPartitions("dominant", "vec_id")

    def build(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()

        def cut(ids, data, asks):
            order = np.argsort(ids, kind="stable")
            ids, data, asks = ids[order], data[order], asks[order]
            return ids, data, data.max(0), data.min(0), asks

        def give(parts, block):
            own = [cut(*p) for p in parts]
            ids = np.concatenate([b[0][b[4]] for b in own])
            asked = np.concatenate([b[1][b[4]] for b in own])
            best, best_ids = search_blocks(asked, ids, [b[:4] for b in own], np.full(len(ids), -np.inf), k)
            kth = np.where(best_ids[:, -1] >= 0, best[:, -1].astype(np.float64), -np.inf)
            out = [("block", shard, block + i, *(x.tobytes() for x in b[:4]), None) for i, b in enumerate(own)]
            if len(ids):
                out.append(("query", shard, block, ids.tobytes(), asked.tobytes(), None, None, kth.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
        names = [c.split()[0] for c in SHARD.split(", ")]
        parts, held, block = [], None, 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data = matrix_of(batch.column(1), width).astype(np.int64)
            asks = np.asarray(batch.column(2).to_pylist(), dtype=object) == True  # noqa: E712  null is no query
            held = [ids, data, asks] if held is None else [np.concatenate(x) for x in zip(held, (ids, data, asks))]
            while len(held[0]) >= block_rows:
                parts.append([x[:block_rows] for x in held])
                held = [x[block_rows:] for x in held]
            if len(parts) * block_rows >= 2 * shard_rows:
                yield give(parts, block)
                block, parts = block + len(parts), []
        if held is not None and len(held[0]):
            parts.append(held)
        if parts:
            yield give(parts, block)

    built = stored(ordered.mapInArrow(build, SHARD), "topk-blocks")
    asked = built.where("kind = 'query'").select(
        F.struct("shard", "block").alias("batch"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "kth"
    )
    # Every batch of queries meets every shard, in tasks of at most about query_rows queries and shard_rows rows.
    highest, asking = built.agg(
        F.coalesce(F.max(F.when(F.col("kind") == "block", F.col("shard"))), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col("kind") == "query", F.octet_length("ids"))), F.lit(0)) / 8,
    ).first()
    parts_ = max(1, math.ceil(asking / query_rows))
    asked = asked.withColumn("part", F.pmod(F.hash("batch"), F.lit(parts_)))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(highest))))
    blocks = built.where("kind = 'block'").select("shard", "ids", "data", "high", "low")
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts_ - 1))))

    def search(key, left, right):
        import pyarrow as pa

        parts = []
        for i in range(right.num_rows):
            ids, data, high, low = (np.frombuffer(right.column(c)[i].as_buffer(), np.int64) for c in ("ids", "data", "high", "low"))
            parts.append((ids, data.reshape(len(ids), -1), high, low))
        out = []
        for i in range(left.num_rows if parts else 0):
            ids = np.frombuffer(left.column("q_ids")[i].as_buffer(), np.int64)
            asked_ = np.frombuffer(left.column("q_data")[i].as_buffer(), np.int64).reshape(len(ids), -1)
            kth = np.frombuffer(left.column("kth")[i].as_buffer(), np.float64)
            best, best_ids = search_blocks(asked_, ids, parts, kth, k)
            at = np.nonzero(best_ids >= 0)
            out.append((ids[at[0]], best_ids[at], best[at]))
        merged = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), merged)))

    found = (
        asked.groupBy("shard", "part")
        .cogroup(blocks.groupBy("shard", "part"))
        .applyInArrow(search, "query_id long, vec_id long, score long")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

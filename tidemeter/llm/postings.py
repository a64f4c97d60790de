"""Approximate nearest neighbours by cosine over balanced posting lists.

Centroids are fitted on a bounded sample by halving it along its widest direction until the wanted number of
equal parts is reached, then a few rounds of assignment with a price on large parts. Every vector goes to its nearest
centroid and, near a boundary, to further ones that are about as near and not behind an earlier one. A query compares
all centroids and keeps the lists whose distance is within a ratio of the nearest. The ratio is measured with queries
against the sample, apart for queries near a centroid and far from any, so that enough true neighbours of both are
covered. Kept lists are scored exactly.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.llm.common import matrix_of, stored, valid_vectors


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances."""
    d = (points**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * points @ centres.T
    return np.maximum(d, 0)


def balanced_centroids(points: np.ndarray, parts: int, rounds: int = 4) -> np.ndarray:
    """Centres of about equally large parts of the sample."""
    groups = [np.arange(len(points))]
    while len(groups) < parts:
        groups.sort(key=len)
        rows = groups.pop()
        if len(rows) < 2:
            groups.append(rows)
            break
        own = points[rows] - points[rows].mean(0)
        axis = own[np.argmax((own**2).sum(1))]
        for _ in range(4):  # power steps towards the widest direction
            axis = own.T @ (own @ axis)
            axis /= np.linalg.norm(axis) or 1.0
        order = rows[np.argsort(own @ axis, kind="stable")]
        groups += [order[: len(order) // 2], order[len(order) // 2 :]]
    centres = np.stack([points[g].mean(0) for g in groups])
    sizes = np.array([len(g) for g in groups], float)
    for _ in range(rounds):
        d = _distances(points, centres)
        price = d.mean() * 0.1 * (sizes / max(1.0, sizes.mean()) - 1)
        own = np.argmin(d + price[None, :], axis=1)
        sizes = np.bincount(own, minlength=len(centres)).astype(float)
        for c in np.flatnonzero(sizes):
            centres[c] = points[own == c].mean(0)
    return centres


def neighbour_graph(centres: np.ndarray, degree: int = 16) -> np.ndarray:
    """The nearest other centres of each; a ring is added so that every centre can be reached."""
    n = len(centres)
    if n == 1:
        return np.zeros((1, 1), np.int64)
    near = []
    for start in range(0, n, 512):
        d = _distances(centres[start : start + 512], centres)
        d[np.arange(len(d)), np.arange(start, start + len(d))] = np.inf
        near.append(np.argsort(d, axis=1, kind="stable")[:, : min(degree, n - 1)])
    ring = np.stack([(np.arange(n) + 1) % n, (np.arange(n) - 1) % n], axis=1)
    return np.hstack([np.concatenate(near), ring])


def graph_lists(
    point: np.ndarray, centres: np.ndarray, graph: np.ndarray, ratio: float, sizes: np.ndarray, least: int, beam: int = 32
) -> list[int]:
    """Centres within ``ratio`` of the nearest one found, by walking the graph nearest first.

    ``sizes`` counts every vector in one list, its nearest. Where the lists so kept hold fewer than ``least`` vectors, the
    walk goes on and the next ones are kept too, all lists if need be.
    """

    def far(which):
        return np.sqrt(np.maximum(((centres[which] - point) ** 2).sum(1), 0))

    seen = np.zeros(len(centres), bool)
    start = np.unique(np.linspace(0, len(centres) - 1, min(8, len(centres))).astype(np.int64))
    seen[start] = True
    heap = [(float(d), int(c)) for d, c in zip(far(start), start)]
    heapq.heapify(heap)
    visited: list[tuple[float, int]] = []
    best, met = math.inf, 0
    while heap:
        d, c = heapq.heappop(heap)
        best = min(best, d)
        if len(visited) >= beam and d > ratio * best + 1e-12 and met >= least:
            break
        visited.append((d, c))
        met += int(sizes[c])
        fresh = np.unique(graph[c])
        fresh = fresh[~seen[fresh]]
        seen[fresh] = True
        for e, x in zip(far(fresh).tolist(), fresh.tolist()):
            heapq.heappush(heap, (e, x))
    kept, met = [], 0
    for d, c in sorted(visited):
        if d > ratio * best + 1e-12 and met >= least:
            break
        kept.append(c)
        met += int(sizes[c])
    return kept


def boundary_lists(points: np.ndarray, centres: np.ndarray, slack: float, most: int) -> list[list[int]]:
    """Lists of every vector: the nearest centre, then near ones that no earlier choice is closer to."""
    out: list[list[int]] = []
    for start in range(0, len(points), 1024):
        d = np.sqrt(_distances(points[start : start + 1024], centres))
        wide = min(d.shape[1], 4 * most)
        near = np.argpartition(d, wide - 1, axis=1)[:, :wide]
        order = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
        for row, candidates in enumerate(order.tolist()):
            chosen = [candidates[0]]
            limit = (1 + slack) * d[row, candidates[0]]
            for c in candidates[1:]:
                if len(chosen) == most or d[row, c] > limit:
                    break
                if all(((centres[c] - centres[x]) ** 2).sum() >= d[row, c] ** 2 for x in chosen):
                    chosen.append(c)
            out.append(chosen)
    return out


#: Queries and sampled rows on which ratios are measured, at most, and queries of one ratio, about.
ASKED, GIVEN, TOGETHER = 1024, 16384, 64
#: Distances below it are rounding.
TINY = 1e-7


def covering_ratios(
    asked: np.ndarray, asked_ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, centres: np.ndarray, slack: float, most: int, k: int, cover: float
) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the distance to the nearest centre, and between them the distance ratio, 1 at least, at which ``cover`` of the
    true neighbours that queries of such a distance have in the sample lie in a kept list.

    Copies lie on a centre and loose rows far from any; one ratio for all would be that of the larger group.
    """
    sample, sample_ids = sample[:GIVEN], sample_ids[:GIVEN]
    if len(sample) <= k or not len(asked):
        return np.empty(0), np.array([math.inf])
    lists = boundary_lists(sample, centres, slack, most)
    filled = np.array([own + own[:1] * (most - len(own)) for own in lists])
    best, need = [], []
    for start in range(0, len(asked), 128):
        part, d = asked[start : start + 128], np.sqrt(_distances(asked[start : start + 128], centres))
        score = part @ sample.T
        score[asked_ids[start : start + 128, None] == sample_ids[None, :]] = -np.inf
        true = np.argpartition(-score, k - 1, axis=1)[:, :k]
        best.append(d.min(1))
        at = np.take_along_axis(d[:, None, :], filled[true].reshape(len(part), 1, -1), 2).reshape(len(part), k, most)
        need.append(at.min(2) / np.maximum(best[-1], TINY)[:, None])
    best, need = np.concatenate(best), np.concatenate(need)
    order = np.argsort(best, kind="stable")
    parts = np.array_split(order, max(1, len(order) // TOGETHER))
    ratios = [max(1.0, float(np.quantile(need[p], cover)) * 1.01) for p in parts]
    return np.array([best[p[0]] for p in parts[1:]]), np.array(ratios)


def near_lists(
    points: np.ndarray, centres: np.ndarray, bounds: np.ndarray, ratios: np.ndarray, sizes: np.ndarray, least: int
) -> list[list[int]]:
    """For every point the centres within the ratio of its nearest one, and further ones until their lists hold ``least`` vectors.

    All centres are compared, since walks over a graph of them can end in a wrong group.
    """
    out: list[list[int]] = []
    for start in range(0, len(points), 512):
        d = np.sqrt(_distances(points[start : start + 512], centres))
        order = np.argsort(d, axis=1, kind="stable")
        d = np.take_along_axis(d, order, 1)
        ratio = ratios[np.searchsorted(bounds, d[:, 0], side="right")]
        with np.errstate(invalid="ignore"):
            near = (d <= (ratio * np.maximum(d[:, 0], TINY))[:, None] + TINY).sum(1)
        held = np.cumsum(sizes[order], axis=1)
        filled = (held < least).sum(1) + 1
        out += [row[:n].tolist() for row, n in zip(order, np.maximum(near, filled))]
    return out


def fixed_order_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in doubles, summed position by position so that equal pairs give equal scores.

    Rows are first scaled by powers of two, which rounds nothing, so that no square overflows or vanishes.
    """
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None]) for x in (a, b))
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for x, y in zip(a.T, b.T):
        dot += x * y
        aa += x * x
        bb += y * y
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    list_rows: int = 256,
    most_lists: int = 4096,
    sample_rows: int = 16384,
    slack: float = 0.1,
    replicas: int = 4,
    cover: float = 0.97,
    piece_rows: int = 2048,
) -> DataFrame:
    """About the k nearest other rows by cosine of every query row: query_id, rank, vec_id, score.

    The centroids (at most ``most_lists``) come from at most about ``sample_rows`` rows and the distance ratios from these and
    at most about ``ASKED`` queries, all chosen by a hash of the id; every row is indexed. Lists that grow beyond ``piece_rows`` are dealt out in
    pieces which are all searched, so no row is lost. A query searches lists of at least k other vectors. Ties go to the smaller id. Vectors that are null, zero or hold
    null or non-finite components, and rows with a null id, take no part. Vectors of different length are compared as
    if filled up with zeros. An empty table gives no rows.
    """
    frame = valid_vectors(vectors, id_column, vector_column)
    frame = frame.where(F.exists("vector", lambda x: x != 0)).select("vec_id", "vector", is_query.alias("asks"))
    frame = stored(frame, "ann-vectors")
    known = frame.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1)), F.count_if("asks")).first()
    rows, width, asking = known
    spark = frame.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if not rows:
        return spark.createDataFrame([], schema)

    def units(column) -> np.ndarray:
        data = matrix_of(column, width).astype(np.float64)
        data = data / np.abs(data).max(1)[:, None]  # no square overflows
        return data / np.sqrt((data**2).sum(1))[:, None]

    def some(of: DataFrame, wanted: int, n: int):
        share = min(1.0, wanted / max(1, n))
        rows_ = of.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec_id", "vector")
        rows_ = rows_.limit(2 * wanted).toArrow().sort_by("vec_id")
        return rows_ if rows_.num_rows else of.select("vec_id", "vector").limit(1).toArrow()

    picked = some(frame, sample_rows, rows)
    sample = units(picked.column("vector"))
    lists = max(1, min(most_lists, math.ceil(rows / list_rows), len(sample)))
    centres = np.unique(np.round(balanced_centroids(sample, lists), 9), axis=0)  # copies have one centre
    probes = some(frame.where("asks"), ASKED, asking)
    if not probes.num_rows:
        return spark.createDataFrame([], schema)
    ids = [x.column("vec_id").to_numpy() for x in (probes, picked)]
    bounds, ratios = covering_ratios(units(probes.column("vector")), ids[0], sample, ids[1], centres, slack, replicas, k, cover)
    index = spark.sparkContext.broadcast((centres, bounds, ratios))  # bounded by most_lists

    def assign(batches):
        import pyarrow as pa

        centres_, _, _ = index.value
        for batch in batches:
            if batch.num_rows:
                chosen = boundary_lists(units(batch.column(1)), centres_, slack, replicas)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chosen, pa.list_(pa.int32()))], ["vec_id", "vector", "lists"])

    def walk(batches):
        import pyarrow as pa

        centres_, bounds_, ratios_ = index.value
        for batch in batches:
            if batch.num_rows:
                chosen = near_lists(units(batch.column(1)), centres_, bounds_, ratios_, sizes, k + 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chosen, pa.list_(pa.int32()))], ["vec_id", "vector", "lists"])

    dealt = "vec_id long, vector array<double>, lists array<int>"
    held = stored(frame.select("vec_id", "vector").mapInArrow(assign, dealt), "ann-lists")
    sizes = np.zeros(len(centres), np.int64)  # vectors by their nearest list
    for row in held.groupBy(F.col("lists")[0].alias("list")).count().collect():
        sizes[row["list"]] = row["count"]
    asked = stored(frame.where("asks").select("vec_id", "vector").mapInArrow(walk, dealt), "ann-queries")
    index.destroy()
    held = held.select(F.explode("lists").alias("list"), "vec_id", "vector")
    asked = asked.select(F.explode("lists").alias("list"), F.col("vec_id").alias("query_id"), F.col("vector").alias("q_vector"))

    # One row per list, so at most most_lists rows: how many pieces its vectors and its queries are dealt into.
    def pieces(frame_, name, most):
        return frame_.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias(name))

    plan = F.broadcast(stored(pieces(held, "cuts", piece_rows).join(pieces(asked, "turns", piece_rows), "list"), "ann-plan"))
    last = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    held = held.join(plan, "list").withColumn("cut", F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("int"))
    held = held.select("list", "cut", F.explode(last("turns")).alias("turn"), "vec_id", "vector")
    asked = asked.join(plan, "list").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int"))
    asked = asked.select("list", F.explode(last("cuts")).alias("cut"), "turn", "query_id", "q_vector")

    def score(key, left, right):
        import pyarrow as pa

        out = []
        if left.num_rows and right.num_rows:
            q, v = matrix_of(left.column("q_vector"), width), matrix_of(right.column("vector"), width)
            qu, vu = units(left.column("q_vector")), units(right.column("vector"))
            q_ids, v_ids = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
            for start in range(0, len(q), 512):
                near = qu[start : start + 512] @ vu.T
                near[q_ids[start : start + 512, None] == v_ids[None, :]] = -np.inf
                kth = np.partition(near, -min(k, near.shape[1]), axis=1)[:, -min(k, near.shape[1])]
                # Rounding of the fast product is far below this margin; what it keeps is scored in a fixed order.
                row, col = np.nonzero((near >= kth[:, None] - 1e-9) & (near > -np.inf))
                exact = fixed_order_cosine(q[start + row], v[col])
                order = np.lexsort((v_ids[col], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                keep = place < k
                out.append((q_ids[start + row[keep]], v_ids[col[keep]], exact[keep]))
        merged = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), merged)))

    found = (
        asked.groupBy("list", "cut", "turn")
        .cogroup(held.groupBy("list", "cut", "turn"))
        .applyInArrow(score, "query_id long, vec_id long, score double")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

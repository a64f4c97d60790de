"""Vector searches against brute force, and their edge cases."""

import math
import os

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from tidemeter.llm import postings, topk
from tidemeter.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def ask():
    return F.col("vec_id") % 50 == 0

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 7) for i, v in rows], SCHEMA)


def brute(rows, k, score):
    out = []
    for q, a in rows:
        if q % 50 == 0:
            found = sorted(((score(a, b), i) for i, b in rows if i != q), key=lambda x: (-x[0], x[1]))[:k]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def whole(a, b):
    return sum(math.floor(256 * float(np.float32(x))) * math.floor(256 * float(np.float32(y))) for x, y in zip(a, b))


@pytest.mark.parametrize("groups", [False, True])
def test_top_k_equals_brute_force_with_ties_over_many_blocks(spark, groups):
    rng = np.random.default_rng(3)
    data = rng.integers(-2, 3, (700, 6)) / 4 + (np.arange(700)[:, None] % 5 if groups else 0)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    found = topk.top_k(frame(spark, rows), ask(), k=5, block_rows=16, shard_rows=100, query_rows=5)
    assert sorted(map(tuple, found.collect())) == brute(rows, 5, whole)


def test_blocks_below_the_kth_score_are_left_out():
    ids, far = np.arange(4), np.full((4, 2), 10)
    near = (np.arange(4) + 4, np.full((4, 2), 100), np.array([100, 100]), np.array([100, 100]))

    class Unread:
        def __getattribute__(self, name):
            raise AssertionError("a pruned block was scored")

    blocks = [near, (ids, Unread(), far.max(0), far.min(0))]
    best, best_ids = topk.search_blocks(np.array([[1, 1]]), np.array([99]), blocks, np.array([-np.inf]), 2)
    assert best.tolist() == [[200, 200]] and best_ids.tolist() == [[4, 5]]


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (6, []), (7, [1.0]), (50, None)]
    found = [tuple(r) for r in topk.top_k(frame(spark, rows), ask(), k=5).orderBy("rank").collect()]
    assert found == [(0, 1, 7, 65536), (0, 2, 5, 32768), (0, 3, 6, 0)]
    assert topk.top_k(frame(spark, []), ask()).collect() == []
    large = topk.top_k(frame(spark, [(0, [1e6] * 40), (1, [1e6] * 40), (2, [-1e6] * 40)]), ask()).orderBy("rank").collect()
    assert [tuple(r) for r in large] == [(0, 1, 1, 40 * 256000000**2), (0, 2, 2, -40 * 256000000**2)]


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


def test_nearest_recall_on_groups_and_on_the_given_table(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    data = (centres[rng.integers(0, 30, 1500)] + 0.3 * rng.normal(size=(1500, 16))).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    found = postings.nearest(frame(spark, rows), ask(), list_rows=50, piece_rows=64).collect()
    true = {(q, i) for q, _, i, _ in brute(rows, 5, cosine)}
    assert len({(r.query_id, r.vec_id) for r in found} & true) >= 0.9 * len(true)
    vectors = dict(rows)
    assert all(math.isclose(r.score, cosine(vectors[r.query_id], vectors[r.vec_id]), abs_tol=1e-12) for r in found)
    table = ds.dataset(f"{SF}/embeddings.parquet").to_table().to_pylist()
    given = [(r["vec_id"], r["embedding"]) for r in table]
    got = {(r.query_id, r.vec_id) for r in QUERIES["op3_balanced_posting_lists"](spark, SF).collect()}
    true = {(q, i) for q, _, i, _ in brute(given, 5, cosine)}
    assert len(got & true) >= 0.9 * len(true)


def test_nearest_edges_and_many_copies(spark):
    same = [(i, [1.0, 2.0, 3.0]) for i in range(300)]
    found = postings.nearest(frame(spark, [*same, (999, [0.0, 0.0, 0.0]), (998, None)]), ask(), list_rows=16, piece_rows=10)
    rows = sorted((r.query_id, r["rank"], r.vec_id) for r in found.collect())
    assert [r for r in rows if r[0] == 0] == [(0, k, k) for k in range(1, 6)]
    assert [r for r in rows if r[0] == 50] == [(50, k + 1, k) for k in range(5)]
    assert postings.nearest(frame(spark, []), ask()).collect() == []
    doubles = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert postings.nearest(doubles([(0, [1e200])]), ask()).collect() == []
    wide = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1e200, -1e-200]), (3, [-3e-310, 0.0]), (4, [1.7e308, 1.7e308])]
    found = sorted(tuple(r)[1:] for r in postings.nearest(doubles(wide), ask()).collect())
    assert [r[:2] for r in found] == [(1, 1), (2, 4), (3, 2), (4, 3)]
    assert [r[2] for r in found] == pytest.approx([1.0, 1.0, 0.5**0.5, -(0.5**0.5)])


def test_queries_of_a_small_far_group_find_k_rows(spark):
    rng = np.random.default_rng(4)
    near = [(i, [1.0, *(1e-4 * rng.normal(size=5)).tolist()]) for i in range(4000)]
    far = [(5000 + 50 * i, [-1.0, 0.1 * i, 0.0, 0.0, 0.0, 0.0]) for i in range(3)]
    found = postings.nearest(frame(spark, near + far), ask(), list_rows=256, most_lists=16).collect()
    for query in (5000, 5050, 5100):
        mine = sorted((r["rank"], r.vec_id) for r in found if r.query_id == query)
        assert len(mine) == 5 and {i for _, i in mine[:2]} == {5000, 5050, 5100} - {query}


def test_loose_queries_among_copies_find_their_neighbours(spark):
    rng = np.random.default_rng(2)
    pool, loose = rng.normal(size=(20, 12)), rng.normal(size=(6000, 12))
    rows = [(i, (loose[i] if i % 50 == 0 or i % 10 == 3 else pool[i % 20]).tolist()) for i in range(6000)]
    found = postings.nearest(frame(spark, rows), ask(), list_rows=64).collect()
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.sqrt((x**2).sum(1))[:, None]
    hits = 0
    for query in range(0, 6000, 50):
        score = x @ x[query]
        score[query] = -2
        hits += sum(r.score >= np.sort(score)[-5] - 1e-9 for r in found if r.query_id == query)
    assert hits >= 0.9 * len(found) and len(found) == 600


def test_graph_walk_finds_the_lists_of_a_scan():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(300, 8))
    graph = postings.neighbour_graph(centres)
    for point in rng.normal(size=(20, 8)):
        d = np.sqrt(((centres - point) ** 2).sum(1))
        found = postings.graph_lists(point, centres, graph, 1.3, np.ones(300, int), 6)
        want = set(np.flatnonzero(d <= 1.3 * d.min()).tolist())
        assert len(want & set(found)) >= 0.9 * len(want)

"""Resampling, whitening and decontamination: brute force, edge cases and skew."""

import hashlib
import math
import os
import re
from zlib import crc32

import numpy as np
import pytest

from tidemeter.llm import decontamination, resampling, whitening
from tidemeter.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = "doc_id long, text string, n_words int, rank int, score string, plain string, y int, map_ map<string,int>"
TEXTS = [
    None, "", "  ,;", "É one TWO", "Ünï Straße ＡＢ 42", "word " * 40, "x" * 5000 + " end", "\x00a\x7fb\tc-d_e",
    " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(3000)),
]


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "s", "p", 3, {"k": 1}) for i, t in rows], CLASHING)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


# resampling


def brute_resample(docs, target, percent):
    def features(text):
        w = words_of(text)
        return [crc32(f.encode()) % 10_000 for f in [*w, *(" ".join(p) for p in zip(w, w[1:]))]]

    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features(text):
                counts[f] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= 20))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    drawn = order[: len(order) * percent // 100]
    out = [(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in order[len(drawn) :]]
    return out + [(*r[:4], None) for r in rows if not r[4]]


def none_last(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("percent", [25, 100])
def test_resampling_against_brute_force(spark, percent):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b " * 15), (3, "again " * 30), (3, "again " * 30)]
    docs += [(100 + i, " ".join(f"t{i % 7}x{j}" for j in range(15 + i % 12))) for i in range(150)]
    target = ["t1x1 t1x2 t1x3 t1x4", None, "", "Straße 42"]
    frame = documents(spark, docs).repartition(5)
    out = resampling.resample(frame, items(spark, list(enumerate(target))), percent=percent).drop("n_words").collect()
    assert none_last(map(tuple, out)) == none_last(brute_resample(docs, target, percent))


def test_ranks_of_many_equal_scores(spark):
    rows = spark.range(30_000).selectExpr("id * 7919 % 30000 AS doc_id", "IF(id % 3 = 0, 5L, id % 11) AS score").repartition(9)
    out = resampling.ranked(rows, 20_000, 16).collect()
    order = sorted(((-r.score, r.doc_id, r["rank"]) for r in out))
    assert [r[2] for r in order] == [k + 1 if k < 20_000 else None for k in range(30_000)]
    scores, ids = resampling.splitters(rows, 16)
    placed = resampling.segment_of(*(np.array([r[c] for r in out]) for c in ("score", "doc_id")), scores, ids)
    assert len(scores) == 15 and np.bincount(placed).max() < 2.5 * 30_000 / 16


def test_resampling_of_empty_tables(spark):
    none = documents(spark, [])
    assert resampling.resample(none, items(spark, [])).collect() == []
    out = resampling.resample(documents(spark, [(1, "a b"), (2, None)]), items(spark, [])).collect()
    assert {(r.doc_id, r.n_features, r["rank"]) for r in out} == {(1, 3, None), (2, 0, None)}


# whitening

VECTORS = "vec_id long, embedding array<double>, y string, n int, component map<string,int>"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1, {"k": 1}) for i, v in rows], VECTORS)


def brute_whiten(rows, components=16):
    width = max(len(v) for _, v in rows)
    x = [tuple(math.floor(64 * c) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]) for _, v in rows]
    fit = np.array(sorted(set(x)), np.int64)
    n, s = len(fit), fit.sum(axis=0)
    scatter = (n * fit.astype(object).T @ fit.astype(object) - np.outer(s.astype(object), s.astype(object))).astype(float) / n**2
    e, v = np.linalg.eigh(scatter)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    keep = e > 1e-9 * e[0]
    e, v = e[keep], v[:, keep]
    centred = np.array(x, np.int64) * n - s
    return n, (centred.astype(object) ** 2).sum(axis=1), (centred / n) @ v / np.sqrt(e), e / np.trace(scatter)


def compare_whitened(out, rows, components=16, distinct=True):
    n, deviation, whitened, explained = brute_whiten(rows, components)
    assert len(out) == whitened.size and {r.n for r in out} == {n}
    assert all(r.identity_error < 1e-9 for r in out) and len({r.identity_error for r in out}) == 1
    by = {(r.vec_id, r.component): r for r in out}
    for k in range(whitened.shape[1]):
        ours = np.array([by[i, k + 1].whitened for i, _ in rows])
        assert math.isclose(by[rows[0][0], k + 1].explained, explained[k], rel_tol=1e-9)
        if distinct:
            assert min(abs(ours - whitened[:, k]).max(), abs(ours + whitened[:, k]).max()) < 1e-8
    assert [by[i, 1].deviation for i, _ in rows] == deviation.tolist()


def test_whitening_against_brute_force(spark):
    random = np.random.default_rng(5)
    base = random.normal(size=(60, 6)) * np.array([5, 3, 2, 1, 0.5, 0.25])
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + i, base[0].tolist()) for i in range(40)] + [(200, base[1, :4].tolist())]
    bad = [(300, None), (301, [1.0, None]), (302, [math.nan] * 6), (303, [math.inf] * 6), (304, [1e300] * 6)]
    compare_whitened(whitening.whiten(vectors(spark, rows + bad).repartition(4)).collect(), rows)
    compare_whitened(whitening.whiten(vectors(spark, rows), components=2).collect(), rows, 2)


def test_whitening_of_equal_roots_and_lost_rank(spark):
    corners = [(i, [float(a), float(b), float(c), float(a + b)]) for i, (a, b, c) in enumerate(np.ndindex(2, 2, 2))]
    compare_whitened(whitening.whiten(vectors(spark, corners)).collect(), corners, distinct=False)
    large = [(i, [1e12 * (i % 5), -3e12 * (i % 3), 0.5 * i]) for i in range(30)]
    out = whitening.whiten(vectors(spark, large)).collect()
    n, deviation, _, explained = brute_whiten(large)
    assert n == 30 and all(r.identity_error < 1e-9 for r in out)
    assert {r.component: r.explained for r in out}[1] == pytest.approx(explained[0], rel=1e-12)
    assert all(r.deviation == (deviation[r.vec_id] if deviation[r.vec_id] < 2**63 else None) for r in out)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]):
        assert whitening.whiten(vectors(spark, rows)).collect() == []


def test_modular_polynomials(spark):
    random = np.random.default_rng(1)
    for d in (1, 2, 5):
        a = random.integers(-9, 9, (d, d))
        a = a @ a.T
        a[0] = a[:, 0] = 0
        expected = np.round(np.poly(a.astype(float))[::-1]).astype(int).tolist()
        assert whitening.characteristic_polynomial(spark, a.tolist()) == expected


def test_registered_whitening(spark):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compare_whitened(QUERIES["op12_exact_whitening"](spark, SF).collect(), rows)


# decontamination


def brute_contaminated(docs, benchmark, length=10):
    windows = {}
    for item, text in benchmark:
        w = words_of(text)
        for i in range(max(1, len(w) - length + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + length]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if held := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= held
        out.append((doc, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


def compare_contaminated(spark, docs, benchmark, **options):
    out = decontamination.contaminated(documents(spark, docs).repartition(3), items(spark, benchmark), **options)
    assert none_last(map(tuple, out.collect())) == none_last(brute_contaminated(docs, benchmark))


def test_decontamination_against_brute_force(spark):
    passage = [f"p{i}" for i in range(25)]
    docs = list(enumerate(TEXTS)) + [(3, "another text of one id"), (None, " ".join(passage)), (None, None)]
    docs += [(50 + i, f"start {i} " + " ".join(passage[i : i + 9 + i % 4]) + ", End") for i in range(14)]
    docs += [(80, " ".join(["a"] * 30)), (81, "b " * 9 + "c"), (82, "P0! p1--P2 p3 p4 p5 p6 p7 p8 p9"), (83, "p0 " * 3 + " ".join(passage)), (83, "p0 " * 3 + " ".join(passage))]
    benchmark = [(1, " ".join(passage)), (2, " ".join(passage)), (10, "w5 w6 w7"), (11, "end"), (12, None), (13, ""), (14, "a " * 12), (15, "one two"), (None, "42"), (2, "straße ＡＢ"), (16, " ".join(f"w{i}" for i in range(90, 104)))]
    compare_contaminated(spark, docs, benchmark)
    compare_contaminated(spark, docs, benchmark, block=4)
    compare_contaminated(spark, docs, benchmark, shingle=1)


def test_decontamination_of_a_large_group(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(i, f"own{i} {passage if i % 3 == 0 else 'nothing here'} tail{i}") for i in range(3000)]
    compare_contaminated(spark, docs, [(i, passage) for i in range(30)])


def test_decontamination_of_empty_tables(spark):
    compare_contaminated(spark, [], [(1, "a b c")])
    compare_contaminated(spark, [(1, "a b c"), (2, None)], [])
    compare_contaminated(spark, [(1, "a b c"), (2, None)], [(1, ""), (2, None)])

"""Operators on hand-worked frames and against brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import tap_frame
from tidemeter.operators import cluster, curves, density, dispersion, goodness, hawkes, intensity, process, ranktests, rates, smoothing
from tidemeter.operators import linkage, split, trips
from tidemeter.sources import facts as facts_io
from tidemeter.sources import ledger as ledger_io
from tidemeter.sources import stations as stations_io

DAY = "2024-01-09 "
FIVE = [("s", DAY + t) for t in ("06:00:10", "06:00:40", "06:03:00", "06:07:00", "06:16:00")]


def by_time(df, *cols):
    return {r["time"]: tuple(r[c] for c in cols) for r in rates.with_calendar(df).collect()}


def test_counts_and_rates(spark):
    taps = tap_frame(spark, FIVE)
    counts = by_time(rates.counts_in(taps), "count_in", "variance_in_1min")
    assert counts[600] == (4, pytest.approx(1 / 3)) and counts[615] == (1, 0.0)
    assert by_time(rates.rate_in(taps), "lambda_in") == {600: (2.0,), 615: (1.0,)}
    assert by_time(rates.rate_in(taps, zero_fill=True), "lambda_in")[600][0] == pytest.approx(4 / 3)
    over = {r["window"].strftime("%H%M"): r for r in rates.overdispersion(taps).collect()}
    assert (over["0600"]["mean"], over["0600"]["var"], over["0600"]["overdispersion"]) == (2.0, 2.0, 1.0)
    assert over["0615"]["var"] is None and over["0615"]["overdispersion"] is None


def test_exits(spark):
    taps = tap_frame(spark, [("s", DAY + "06:00:00", None, 4.0), ("s", DAY + "06:14:59", None, 5.0)])
    assert rates.counts_out(taps).first()["count_out"] == 9
    assert rates.rate_out(taps).first()["lambda_out"] == 3.0


def test_rolling_rate_and_ticks(spark):
    counts = [("06:00", 2), ("06:10", 4), ("06:15", 6), ("06:20", 8)]
    rows = [("s", f"{DAY}{t}:{i:02d}") for t, n in counts for i in range(n)] + [("z", DAY + "06:41:00")]
    taps = tap_frame(spark, rows)
    est = rates.rolling_rate(taps).where("station = 's'").orderBy("w").collect()
    assert [r["estimate"] for r in est] == [2, 3, 4, 6]
    ticks = rates.sampled_rate(taps).where("station = 's'").orderBy("tick").collect()
    assert [(r["tick"].strftime("%H%M"), r["estimate"]) for r in ticks] == [("0600", 2), ("0615", 4), ("0630", 6)]


def test_trips_and_rolling_shares(spark):
    taps = tap_frame(spark, [("A", DAY + "06:00:00", "c"), ("A", DAY + "06:05:00", "c"), ("B", DAY + "06:10:00", "c"), ("A", DAY + "07:00:00", "c")])
    found = trips.trips(taps).orderBy("t2").collect()
    assert [(r["origin"], r["destination"], r["t1"].strftime("%H%M")) for r in found] == [("A", "B", "0605"), ("B", "A", "0610")]
    live = trips.rolling_shares(trips.trips(taps)).collect()
    assert [(r["tick"].strftime("%H%M"), r["origin"], r["destination"], r["p"]) for r in live] == [("0615", "A", "B", 1.0)]


def test_batches(spark):
    taps = tap_frame(spark, [("s", f"{DAY}06:00:{s:02d}") for s in (0, 5, 11, 20)])
    assert [r["ts"].second for r in trips.batches(taps, 5.0).orderBy("ts").collect()] == [0, 11, 20]
    assert [r["batch"] for r in trips.batch_ids(taps, 5.0).orderBy("ts").collect()] == [1, 1, 2, 3]


def test_split_operators_agree_with_one_sort_and_spread_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.9 else f"k{rng.randrange(20)}", int(rng.paretovariate(0.3)) % 10**9, i) for i in range(12_000)]
    rows += [(None, 5, 20_000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, id int").withColumn("one", F.lit(1)).repartition(5)
    both = split.in_order(df, ["k"], ["t", "id"], totals={"c": "one"}, before=("p", ["id"]))
    pdf = pd.DataFrame(rows, columns=["k", "t", "id"]).sort_values(["k", "t", "id"])
    grouped = pdf.groupby("k", dropna=False)
    expected = dict(zip(pdf["id"], zip(grouped.cumcount() + 1, grouped["id"].shift(1))))
    found = both.collect()
    assert len(found) == len(rows)
    for r in found:
        count, before = expected[r["id"]]
        assert r["c"] == count and ((r["p"] is None and before != before) or r["p"]["id"] == before)
    sizes = [r["count"] for r in split.cut(df, ["k"], ["t", "id"]).where("k = 'hot'").groupBy("_piece").count().collect()]
    assert len(sizes) > 20 and max(sizes) <= 3 * len(rows) / (4 * 8)


def test_split_operators_without_keys_and_rows(spark):
    df = spark.createDataFrame([(i * 37 % 1000,) for i in range(1000)], "t int").withColumn("one", F.lit(1))
    assert all(r["c"] == r["t"] + 1 for r in split.running_total(df, [], ["t"], {"c": "one"}).collect())
    assert split.running_total(df.where("t < 0"), [], ["t"], {"c": "one"}).collect() == []


def test_ranks_with_a_value_that_dominates(spark):
    rng = random.Random(2)
    values = [0.0] * 400 + [round(rng.random() * 50, 1) for _ in range(500)]
    df = spark.createDataFrame([("s", v) for v in values], "station string, v double")
    got = {r["v"]: r["avg_rank"] for r in ranktests.average_ranks(df, ["station"], "v").collect()}
    want = pd.Series(values).rank()
    assert all(got[v] == pytest.approx(w) for v, w in zip(values, want))


def test_rank_tests(spark):
    df = spark.createDataFrame([("s", "a", 1.0), ("s", "a", 2.0), ("s", "b", 3.0), ("s", "b", 4.0)], "station string, g string, v double")
    assert ranktests.kruskal(df, ["station"], "g", "v").first()["h_stat"] == pytest.approx(2.4)
    squared = df.withColumn("v", F.exp("v"))
    assert ranktests.kruskal(squared, ["station"], "g", "v").first()["h_stat"] == pytest.approx(2.4)
    u = ranktests.mann_whitney(df, ["station"], "g", "a", "b", "v").first()
    assert (u["u_stat"], u["n1"], u["n2"]) == (0.0, 2, 2)


def test_transforms(spark):
    taps = tap_frame(spark, [("s", DAY + "06:01:40"), ("s", DAY + "06:03:20")])
    rows = process.arrival_transforms(taps).orderBy("j").collect()
    assert [r["cu"] for r in rows] == pytest.approx([1 / 3, 2 / 3])
    assert [r["log_exp"] for r in rows] == pytest.approx([0.810930, 0.693147], abs=1e-6)
    assert [r["lewis"] for r in rows] == pytest.approx([1.0, 1.0])


def test_dispersion_across_days(spark):
    dense = spark.createDataFrame([("s", "WD", "d1", 600, 15, 2.0), ("s", "WD", "d2", 600, 15, 0.5)],
                                  "station string, date_type string, date string, time int, c int, v double")
    assert curves.daily_dispersion(dense, "c", "v").first()["r"] == 1.0


def test_accuracy(spark):
    pairs = spark.createDataFrame([("s", 0.0, 1.0), ("s", 2.0, 2.0), ("s", 4.0, 2.0)], "station string, actual double, predicted double")
    r = curves.accuracy(pairs, ["station"]).first()
    assert (r["mae"], r["mape"], r["r2"]) == pytest.approx((1, 25, 0.375)) and r["rmse"] == pytest.approx(1.290994, abs=1e-6)


def test_degenerate_inputs_give_nulls_and_no_errors(spark):
    flat = spark.createDataFrame([("s", 1, m, 1) for m in range(240, 300)], "station string, d int, minute int, n int")
    assert process.cameron_trivedi(flat, ["station", "d"]).first()["slope"] is None
    single = spark.createDataFrame([("s", 240, 1.0)], "station string, t int, r double")
    assert curves.integrate(single, ["station"], "t", "r").first()["m"] is None
    one = tap_frame(spark, [("s", DAY + "06:00:00", "c"), ("s", DAY + "06:01:00", "c")])
    row = trips.repeat_summary(one).first()
    assert (row["repeat_cards"], row["std"], row["mean"]) == (1, None, 2.0)
    assert goodness.spanning_histogram(single, "r", 5).first()["bin"] == 0
    assert cluster.adjusted_rand(spark.createDataFrame([(0, 1)], "a int, b int"), [], "a", "b").first()["ari"] == 1.0


def test_adjusted_rand(spark):
    same = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0)], "a int, b int")
    assert cluster.adjusted_rand(same, [], "a", "b").first()["ari"] == 1.0


def brute_dbscan(secs, eps, k):
    secs = sorted(secs)
    core = [sum(abs(a - b) <= eps for b in secs) >= k for a in secs]
    labels, current = [-1] * len(secs), -1
    for i in range(len(secs)):
        if not core[i] or labels[i] != -1:
            continue
        current += 1
        todo = [i]
        while todo:
            j = todo.pop()
            for m in range(len(secs)):
                if abs(secs[j] - secs[m]) <= eps and labels[m] == -1:
                    labels[m] = current
                    if core[m]:
                        todo.append(m)
    return list(zip(secs, labels))


def test_density_frames_are_read_once_in_crowded_days(spark):
    """No frame is added up anew for every second: all begin at the start of the day and end at or before the row."""
    base = pd.Timestamp(DAY + "08:00:00")
    taps = tap_frame(spark, [("s", str(base + pd.Timedelta(seconds=s))) for s in (0, 0, 1, 60, 61, 300, 361, 362, 500)])
    found = density.clusters(density.arrival_seconds(taps), 60, 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe" in plan and "unboundedfollowing" not in plan and "RangeFrame, -" not in plan
    got = {r.sec: (r.neighbours, r.cluster) for r in found.collect()}
    assert got == {0: (4, 0), 1: (5, 0), 60: (5, 0), 61: (3, 0), 300: (1, -1), 361: (2, 1), 362: (2, 1), 500: (1, -1)}


@pytest.mark.parametrize("secs", [[0, 30, 60, 200, 1000], None])
def test_density_clusters(spark, secs):
    if secs is None:
        rng = random.Random(3)
        secs = sorted(rng.randrange(0, 6000) for _ in range(150))
        secs = [s - secs[0] for s in secs]
    base = pd.Timestamp(DAY + "06:00:00")
    taps = tap_frame(spark, [("s", str(base + pd.Timedelta(seconds=s))) for s in secs])
    got = density.clusters(density.arrival_seconds(taps), 60, 3).collect()
    found = sorted((r["sec"], r["cluster"]) for r in got for _ in range(r["n"]))
    assert found == sorted(brute_dbscan(secs, 60, 3))


def random_taps(spark, n=120, seed=4, hot_second=0):
    rng = random.Random(seed)
    base = pd.Timestamp(DAY + "04:00:00")
    secs = [rng.randrange(0, 60 * 1100) for _ in range(n)] + [30_000] * hot_second
    return tap_frame(spark, [("s", str(base + pd.Timedelta(seconds=s))) for s in secs]), sorted(240 + s / 60 for s in secs)


def test_likeliest_cell_of_a_crowded_day_by_direct_sums():
    """A fold of the day for every cell took minutes for days of this size; sums before a second are checked pair by pair."""
    rng = np.random.default_rng(5)
    second, n = np.unique(rng.integers(14_400, 82_800, 60_000), return_counts=True)
    few = slice(0, 400)
    for beta in (1e-8, 0.3, 40.0, 1e3):
        got = hawkes._sums_before(second[few] - second[0], n[few], beta)
        age = (second[few][:, None] - second[few][None, :]) / 60
        assert np.allclose(got, np.where(age > 0, n[few] * np.exp(-beta * np.maximum(age, 0)), 0).sum(axis=1), rtol=1e-9, atol=0)
    mu = np.full(len(second), 50.0)
    alpha, beta, value = hawkes._likeliest(second, n, mu, 57_000.0, 1380.0)
    held, direct = 0.0, -57_000.0
    for k, t in enumerate(second / 60):
        held = held * math.exp(-beta * (t - second[k - 1] / 60)) if k else 0.0
        direct += sum(math.log(50 + alpha * (held + j)) for j in range(n[k])) - alpha * n[k] * (1 - math.exp(-beta * (1380 - t))) / beta
        held += n[k]
    assert value == pytest.approx(direct, abs=1e-3)


def test_kernel_intensity_matches_direct_sum(spark):
    taps, times = random_taps(spark)
    grid = intensity.kernel_intensity(taps).orderBy("minute").collect()
    minutes = np.floor(times)
    for r in grid[::97]:
        direct = np.exp(-0.5 * ((r["minute"] - minutes) / 5) ** 2).sum() / (5 * math.sqrt(2 * math.pi))
        assert r["intensity"] == pytest.approx(direct, abs=1e-12)
    assert sum(r["n"] for r in grid) == len(times)


def brute_log_likelihood(times, mu, mass, alpha, beta, end):
    total = 0.0
    for i, t in enumerate(times):
        total += math.log(mu[i] + alpha * sum(math.exp(-beta * (t - u)) for u in times[:i]))
    return total - mass - alpha / beta * sum(1 - math.exp(-beta * (end - t)) for t in times)


@pytest.mark.parametrize("hot", [0, 90])
def test_self_exciting_fit(spark, hot):
    taps, times = random_taps(spark, 80, hot_second=hot)
    fitted = hawkes.fit(taps).persist()
    p = hawkes.parameters(fitted).first()
    grid = intensity.kernel_intensity(taps).orderBy("minute").collect()
    lam = np.array([r["intensity"] for r in grid])
    minutes = np.arange(240, 1381)
    mu = np.interp(times, minutes, lam)
    mass = float(((lam[1:] + lam[:-1]) / 2).sum())
    best = brute_log_likelihood(times, mu, mass, p["alpha"], p["beta"], 1380.0)
    assert p["loglik"] == pytest.approx(best, rel=1e-6)
    for a in (0.5, 1.0, 1.3):
        for b in (0.5, 1.0, 1.3):
            beta = min(p["beta"] * b, hawkes.HIGH)  # a burst in one second pushes the decay to its bound
            assert brute_log_likelihood(times, mu, mass, p["alpha"] * a, beta, 1380.0) <= best + 1e-6
    assert p["events"] == len(times)
    assert fitted.where("tau < -1e-9").count() == 0


def test_decay_recursion(spark):
    taps, times = random_taps(spark, 60, hot_second=3)
    r = hawkes.decay_sums(taps, [0.05]).first()
    s = [sum(math.exp(-0.05 * (t - u)) for u in times[:i]) for i, t in enumerate(times)]
    assert r["s_total"] == pytest.approx(sum(s)) and r["s_last"] == pytest.approx(s[-1])


def nb_log_likelihood(k, mean, counts):
    r = 1 / k
    gammas = sum(math.lgamma(v + r) - math.lgamma(r) - math.lgamma(v + 1) for v in counts)
    return gammas - ((counts + r) * np.log1p(k * mean)).sum() + (counts * np.log(k * mean)).sum()


def test_nb_dispersion_is_a_maximum(spark):
    taps, _ = random_taps(spark, 400, hot_second=40)
    grid = intensity.kernel_intensity(taps).persist()
    fit = dispersion.fit_k(grid).first()
    rows = grid.collect()
    mean = np.maximum([r["intensity"] for r in rows], 1e-6)
    counts = np.array([r["n"] for r in rows], float)
    assert fit["loglik"] == pytest.approx(nb_log_likelihood(fit["k"], mean, counts))
    for factor in (0.8, 0.999, 1.001, 1.25):
        assert nb_log_likelihood(fit["k"] * factor, mean, counts) <= fit["loglik"] + 1e-9
    pit = dispersion.randomised_pit(grid, dispersion.fit_k(grid))
    stats = pit.agg(F.min("u"), F.max("u"), F.count("u")).first()
    assert 0 <= stats[0] and stats[1] <= 1 and stats[2] == len(rows)


def test_bootstrap_does_not_depend_on_partitions(spark):
    taps, _ = random_taps(spark, 200)
    series = intensity.minute_series(intensity.minute_counts(taps))
    first, second = (dispersion.bootstrap_k(s).first() for s in (series, series.repartition(5)))
    assert first == second and first["k_low"] <= first["k_mean"] <= first["k_high"]


def dense_smoothing(x, y, budget, at):
    """The same curve by dense matrices: value and slope at given places, sse, and second derivatives."""
    n, h = len(x), np.diff(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j : j + 3, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j:
            r[j, j - 1] = r[j - 1, j] = h[j] / 6
    fit = lambda penalty: y - penalty * q @ np.linalg.solve(r + penalty * q.T @ q, q.T @ y)
    values = np.polyval(np.polyfit(x, y, 1), x)
    if ((y - values) ** 2).sum() > budget:
        low, high = -25.0, 40.0
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if ((y - fit(math.exp(middle))) ** 2).sum() <= budget else (low, middle)
        values = fit(math.exp(low)) if budget > 0 else y
    g = np.concatenate([[0], np.linalg.solve(r, q.T @ values), [0]])
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    w = x[i + 1] - x[i]
    a, b = (x[i + 1] - at) / w, (at - x[i]) / w
    value = a * values[i] + b * values[i + 1] + ((a**3 - a) * g[i] + (b**3 - b) * g[i + 1]) * w**2 / 6
    slope = (values[i + 1] - values[i]) / w + ((1 - 3 * a**2) * g[i] + (3 * b**2 - 1) * g[i + 1]) * w / 6
    return value, slope, ((y - values) ** 2).sum()


@pytest.mark.parametrize("budget", [10.0, 1.0, 0.0])
def test_smoothing_against_dense_matrices(spark, budget):
    rng = np.random.default_rng(0)
    even = np.arange(240.0, 1381, 15)
    uneven = np.sort(rng.choice(even, 30, replace=False))
    waves = {"a": (even, 5 + 4 * np.sin(even / 150) + rng.normal(0, 0.5, len(even))), "b": (uneven, np.cos(uneven / 90) + rng.normal(0, 0.5, 30))}
    waves |= {"line": (even, 2 * even + 1), "three": (np.array([0.0, 2.0, 3.0]), np.array([1.0, 5.0, -4.0]))}
    rows = [(s, "WD", float(a), float(b)) for s, (x, y) in waves.items() for a, b in zip(x, y)] + [("one", "WD", 4.0, 7.0), ("two", "WD", 1.0, 2.0), ("two", "WD", 3.0, 6.0)]
    df = spark.createDataFrame(rows, "station string, date_type string, t double, v double")
    got = smoothing.smooth_curves(df, "t", "v", budget).toPandas().sort_values("i")
    for station, (x, y) in waves.items():
        of = got[got["station"] == station]
        value, slope, sse = dense_smoothing(x, y, budget, np.linspace(x[0], x[-1], 3 * len(x)))
        assert of["value"].to_numpy() == pytest.approx(value, abs=1e-6) and of["slope"].to_numpy() == pytest.approx(slope, abs=1e-6)
        assert of["sse"].iloc[0] == pytest.approx(sse, abs=1e-7)
    assert set(got[got["station"] == "one"]["value"]) == {7.0}
    assert got[got["station"] == "two"]["value"].tolist() == pytest.approx(np.linspace(2, 6, 6).tolist())


def test_pair_correlation_matches_all_pairs(spark):
    rng = np.random.default_rng(1)
    data = rng.random((12, 9))
    rows = [("s", "WD", [float(v) for v in c]) for c in data] + [("s", "WD", [1.0] * 9)]
    df = spark.createDataFrame(rows, "station string, date_type string, curve array<double>").repartition(4)
    got = cluster.pair_correlation(df, ["station", "date_type"]).first()
    r = np.corrcoef(data)[np.triu_indices(12, 1)]
    assert (got["n_days"], got["n_curves"]) == (13, 12)  # the flat day counts as a day
    assert (got["mean_corr"], got["std_corr"]) == (pytest.approx(r.mean()), pytest.approx(r.std()))


def unit_rows(rng, n, width=6):
    z = rng.random((n, width)) + 2 * np.eye(width)[rng.integers(0, width, n)]
    z -= z.mean(axis=1, keepdims=True)
    return z / np.linalg.norm(z, axis=1, keepdims=True)


def plain_linkage(z, k):
    """Closest pair first, by mean distances kept up to date."""
    gap = 1 - z @ z.T
    np.fill_diagonal(gap, np.inf)
    size, members = np.ones(len(z)), {i: [i] for i in range(len(z))}
    while len(members) > k:
        i, j = sorted(np.unravel_index(gap.argmin(), gap.shape))
        gap[i] = (size[i] * gap[i] + size[j] * gap[j]) / (size[i] + size[j])
        gap[:, i] = gap[i]
        gap[i, i], gap[j], gap[:, j] = np.inf, np.inf, np.inf
        size[i] += size[j]
        members[i] += members.pop(j)
    return {frozenset(m) for m in members.values()}


@pytest.mark.parametrize("sizes, block", [((20, 1, 3), 1024), ((257,), 64), ((500, 40), 1024)])
def test_average_linkage_equals_plain_linkage(spark, monkeypatch, sizes, block):
    monkeypatch.setattr(linkage, "BLOCK", block)
    rng = np.random.default_rng(2)
    z = {f"T{t}": unit_rows(rng, n) for t, n in enumerate(sizes)}
    rows = [(f"{i:04d}", t, x.tolist()) for t, part in z.items() for i, x in enumerate(part)]
    curves = spark.createDataFrame([*rows, ("flat", "T0", [1.0] * 6)], "station string, date_type string, curve array<double>")
    got = cluster.hierarchy(curves, 4).toPandas()
    assert len(got) == len(rows)
    for t, part in z.items():
        of = got[got["date_type"] == t]
        found = [frozenset(g["station"].astype(int)) for _, g in of.groupby("cluster")]
        assert set(found) == plain_linkage(part, 4) and [min(g) for g in found] == sorted(min(g) for g in found)


def test_equal_curves_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK", 4)
    monkeypatch.setattr(linkage, "FEW", 1)
    rounds, merge_round = [], linkage.merge_round
    monkeypatch.setattr(linkage, "merge_round", lambda *a: rounds.append(1) or merge_round(*a))
    z = unit_rows(np.random.default_rng(5), 12)
    rows = [(f"{c * 12 + i:04d}", "T", x.tolist()) for c in range(15) for i, x in enumerate(z)]
    rows += rows[:2]  # two stations come twice
    got = cluster.hierarchy(spark.createDataFrame(rows, "station string, date_type string, curve array<double>"), 4).toPandas()
    assert len(got) == len(rows) and len(rounds) <= 8
    found = {frozenset(g["station"].astype(int) % 12) for _, g in got.groupby("cluster")}
    assert found == plain_linkage(z, 4)


def shuffled(spark):
    """Bytes that all shuffles of the session have written so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_rounds_of_all_write_no_centre_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK", 8)
    monkeypatch.setattr(linkage, "FEW", 12)
    monkeypatch.setattr(linkage, "PACK", 2)
    rng = np.random.default_rng(3)
    z = {"A": unit_rows(rng, 260, 32), "B": unit_rows(rng, 40, 32)}
    rows = [(f"{i:04d}", t, x.tolist()) for t, part in z.items() for i, x in enumerate(part)]
    curves = spark.createDataFrame(rows, "station string, date_type string, curve array<double>").repartition(3)
    before = shuffled(spark)
    got = cluster.hierarchy(curves, 4).toPandas()
    assert shuffled(spark) - before < 15 * len(rows) * 32 * 8  # once for each block would be over 30 times in the first round
    for t, part in z.items():
        found = {frozenset(g["station"].astype(int)) for _, g in got[got["date_type"] == t].groupby("cluster")}
        assert found == plain_linkage(part, 4)


def test_remaining_rounds_in_one_task_equal_rounds_of_all(spark, monkeypatch):
    rows = [(f"{i:03d}", "T", x.tolist()) for i, x in enumerate(unit_rows(np.random.default_rng(9), 90))]
    curves = spark.createDataFrame(rows, "station string, date_type string, curve array<double>")
    found = []
    for block in (4096, 8):
        monkeypatch.setattr(linkage, "BLOCK", block)
        found.append({(r["station"], r["cluster"]) for r in cluster.hierarchy(curves, 5).collect()})
    assert found[0] == found[1]


def blobs(spark, sizes, width=5):
    rng = np.random.default_rng(8)
    x = {f"T{t}": rng.normal(size=(n, width)) + 3 * rng.integers(0, 3, (n, 1)) for t, n in enumerate(sizes)}
    rows = [(f"{i:03d}", t, v.tolist()) for t, part in x.items() for i, v in enumerate(part)]
    return x, spark.createDataFrame(rows, "station string, date_type string, curve array<double>").repartition(4)


def scaled(x):
    return (x - x.mean(axis=0)) / x.std(axis=0)


def start(x, date_type, k, seed):
    import hashlib

    picked = [min(range(len(x)), key=lambda i: hashlib.md5(f"{seed}:{i:03d}".encode()).hexdigest())]
    while len(picked) < k:
        picked.append(int(((x[:, None] - x[picked][None]) ** 2).sum(axis=2).min(axis=1).argmax()))
    return x[picked]


def plain_lloyd(x, centres):
    while True:
        label = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[label == c].mean(axis=0) if (label == c).any() else centres[c] for c in range(len(centres))])
        if np.allclose(moved, centres, atol=1e-9):
            return label
        centres = moved


def test_kmeans_and_stability_against_plain_lloyd(spark):
    x, df = blobs(spark, (60, 45, 2))
    got = {(r["date_type"], int(r["station"])): r["cluster"] for r in cluster.kmeans_by_type(df, {"T0": 3, "T1": 4}).collect()}
    labels = {t: plain_lloyd(scaled(x[t]), start(scaled(x[t]), t, k, 42)) for t, k in (("T0", 3), ("T1", 4))}
    assert got == {(t, i): c for t, of in labels.items() for i, c in enumerate(of)}
    for r in cluster.stability(df, k_values=(2, 3), seeds=(0, 42)).collect():
        z, k = scaled(x[r["date_type"]]), r["n_clusters"]
        a, b = (plain_lloyd(z, start(z, r["date_type"], k, s)) for s in (0, 42))
        gap = ((z[:, None] - z[None]) ** 2).sum(axis=2)
        own = np.array([gap[i, a == a[i]].sum() / max((a == a[i]).sum() - 1, 1) for i in range(len(z))])
        other = np.array([min(gap[i, a == c].mean() for c in set(a) - {a[i]}) for i in range(len(z))])
        assert r["silhouette"] == pytest.approx(((other - own) / np.maximum(own, other)).mean())
        pairs = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a int, b int")
        assert r["mean_ari"] == pytest.approx(cluster.adjusted_rand(pairs, [], "a", "b").first()["ari"])


def test_mixtures_against_plain_em(spark):
    x, df = blobs(spark, (60, 4), width=7)  # four stations of seven positions: only the ridge makes the covariance regular
    got = {(r["date_type"], int(r["station"])): r["cluster"] for r in cluster.mixture_by_type(df, {"T0": 3, "T1": 2}).collect()}
    assert len(got) == 64
    for t, k in (("T0", 3), ("T1", 2)):
        z = scaled(x[t])
        r = np.eye(k)[((z[:, None] - start(z, t, k, 42)[None]) ** 2).sum(axis=2).argmin(axis=1)]
        before = -np.inf
        for _ in range(100):
            n = r.sum(axis=0)
            means = r.T @ z / n[:, None]
            spread = [(z - m).T @ ((z - m) * r[:, [c]]) / n[c] + 1e-6 * np.eye(7) for c, m in enumerate(means)]
            logs = np.stack(
                [np.log(n[c] / len(z)) - 0.5 * (7 * np.log(2 * np.pi) + np.linalg.slogdet(s)[1] + np.einsum("ij,ij->i", (z - m) @ np.linalg.inv(s), z - m)) for c, (m, s) in enumerate(zip(means, spread))],
                axis=1,
            )
            value = np.log(np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)) + logs.max(axis=1)
            r = np.exp(logs - value[:, None])
            if value.mean() - before < 1e-3:
                break
            before = value.mean()
        assert [got[t, i] for i in range(len(z))] == logs.argmax(axis=1).tolist()


def test_projection_against_eigenvectors(spark):
    x, df = blobs(spark, (30, 12, 1))
    got = {(r["date_type"], int(r["station"])): r for r in cluster.projection(df).collect()}
    assert len(got) == 42
    for t in ("T0", "T1"):
        z = x[t] - x[t].mean(axis=0)
        _, s, v = np.linalg.svd(z)
        assert got[t, 0]["explained2"] == pytest.approx(s[1] ** 2 / (s * s).sum())
        for c in (0, 1):
            sign = np.sign(v[c][np.abs(v[c]).argmax()])
            assert [got[t, i][f"pc{c + 1}"] for i in range(len(z))] == pytest.approx((z @ v[c] * sign).tolist())


def test_normality_against_direct_formulas(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(10, 2, 300), 1)
    df = spark.createDataFrame([("s", float(v)) for v in x], "station string, v double")
    got = goodness.normality_ranks(df, ["station"], "v").first()
    nd = __import__("statistics").NormalDist()
    z = np.sort((x - x.mean()) / x.std(ddof=1))
    p = np.array([nd.cdf(v) for v in z])
    i = np.arange(1, 301)
    a2 = -300 - ((2 * i - 1) / 300 * (np.log(p) + np.log(1 - p[::-1]))).sum()
    ks = max((i / 300 - p).max(), (p - (i - 1) / 300).max())
    assert got["anderson"] == pytest.approx(a2, rel=1e-9) and got["ks"] == pytest.approx(ks, rel=1e-9)
    assert 0.98 < got["shapiro"] <= 1 and got["shapiro_p"] > 0.01


def test_upsert_is_idempotent_and_partial(spark):
    keys = ["k"]
    stored = spark.createDataFrame([("k", 5, None), ("old", 1, 2)], "k string, count_in int, count_out int")
    incoming = spark.createDataFrame([("k", 9), ("new", 3)], "k string, count_out int")
    once = facts_io.upsert(stored, incoming, keys, ["count_in", "count_out"])
    twice = facts_io.upsert(once, incoming, keys, ["count_in", "count_out"])
    want = [("k", 5, 9), ("new", None, 3), ("old", 1, 2)]
    assert [tuple(r) for r in once.orderBy("k").collect()] == want
    assert [tuple(r) for r in twice.orderBy("k").collect()] == want


def test_stations_and_ledger(spark):
    dim = spark.createDataFrame([(7, "001", "A")], "id int, code string, name string")
    found = spark.createDataFrame([("001", "A"), ("003", "C"), ("002", "B")], "code string, name string")
    assert [tuple(r) for r in stations_io.insert_members(dim, found).orderBy("id").collect()] == [(7, "001", "A"), (8, "002", "B"), (9, "003", "C")]
    with pytest.raises(ValueError):
        stations_io.create_station(dim, "001", "again")
    files = spark.createDataFrame([("f1", "p"), ("f2", "p")], "filename string, process_type string")
    ledger = ledger_io.mark_processed(ledger_io.get_or_create(ledger_io.empty(spark), files), files.where("filename = 'f1'"))
    assert [r["filename"] for r in ledger_io.unprocessed(files, ledger).collect()] == ["f2"]
    assert ledger_io.is_processed(ledger, "f1", "p") and not ledger_io.is_processed(ledger, "f2", "p")
    assert ledger_io.delete(ledger, "f1").count() == 1 and ledger_io.by_file(ledger, "f2").count() == 1


def test_fact_point_access(spark):
    facts = spark.createDataFrame([("s", 600, 1, None)], "station string, time int, count_in int, count_out int")
    more = facts_io.create(facts, ["station", "time"], ["count_in"], station="s", time=615, count_in=4)
    assert facts_io.exists(more, station="s", time=615) and not facts_io.exists(more, station="t", time=615)
    with pytest.raises(ValueError):
        facts_io.create(facts, ["station", "time"], ["count_in"], station="s", time=600, count_in=4)
    changed = facts_io.update(more, {"count_out": 9, "count_in": None}, station="s", time=600)
    assert tuple(facts_io.get(changed, station="s", time=600).first()) == ("s", 600, 1, 9)

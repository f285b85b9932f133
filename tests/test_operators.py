"""Operators against literal answers and brute force, in both the small and the piecewise form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixhaz.operators import lookup, prefix, ranking, resample, summaries, survival
from mixhaz.operators.scaling import InputError, check_scalar


@pytest.fixture(params=["small", "leaves", "pieces"])
def size(request, monkeypatch):
    """Run a test with one-task ordering and one index, with ordering cut into pieces and an index of leaves, and without an index."""
    if request.param != "small":
        monkeypatch.setattr(prefix, "SMALL_TABLE", 0)
        monkeypatch.setattr(ranking, "BLOCK_ROWS", 40)
        monkeypatch.setattr(lookup, "INDEX_ROWS", 2)
        monkeypatch.setattr(lookup, "LEAF", 3)
    if request.param == "pieces":
        monkeypatch.setattr(lookup, "_by_leaves", lambda *a: lookup._by_pieces(*a[:-1]))
    return request.param


def test_cumhaz_lookup(spark, size):
    grid = spark.createDataFrame([(2.0, .1), (4.0, .5), (6.0, .9)], "time double, cumhaz double")
    asked = spark.createDataFrame([(i, float(t)) for i, t in enumerate((7, 1, .5, 3, 1.5, 6, 2))], "i int, time double")
    got = [r["cumhaz"] for r in survival.cumhaz_at(asked, grid).orderBy("i").collect()]
    assert got == [.9, 0, 0, .1, 0, .9, .1]
    assert [r["cumhaz"] for r in survival.cumhaz_at(asked, survival.empty_baseline(spark)).collect()] == [0] * 7


def test_jump_lookup_before_grid(spark, size):
    grid = spark.createDataFrame([(2.0, .3), (4.0, .5)], "time double, jump double")
    asked = spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "time double")
    assert [r["jump"] for r in survival.jump_at(asked, grid).orderBy("time").collect()] == [.3, .3, .5]


def test_forward_lookup_skips_empty_pieces(spark, size):
    rng = np.random.default_rng(1)
    g = np.sort(np.concatenate([rng.random(50), 100 + rng.random(50)]))
    q = np.concatenate([rng.random(30) * 120, [g[3], g[-1], g[-1] + 1]])
    grid = spark.createDataFrame([(float(v), i) for i, v in enumerate(g)], "x double, i int")
    asked = spark.createDataFrame([(float(v), j) for j, v in enumerate(q)], "x double, j int")
    for way, side in (("forward", "left"), ("backward", "right")):
        got = {r["j"]: r["i"] for r in lookup.asof(asked, grid, "x", ["i"], direction=way).collect()}
        at = np.searchsorted(g, q, side=side)
        want = at if way == "forward" else at - 1
        assert got == {j: (int(w) if 0 <= w < len(g) else None) for j, w in enumerate(want)}


def test_lookup_by_key_with_missing_values(spark, size):
    rng = np.random.default_rng(9)
    grid = [(k, float(t), int(v)) for k in ("a", "b", None) for t, v in zip(np.sort(rng.choice(60, 20, replace=False)), rng.integers(0, 99, 20))]
    asked = [(i, k, None if i % 11 == 0 else float(t)) for i, (k, t) in enumerate(zip(rng.choice(["a", "b", "c"], 90), rng.integers(-5, 70, 90)))]
    asked = [(i, str(k), 7.0 if i % 3 == 0 and t is not None else t) for i, k, t in asked]  # a third asks for one value
    g = spark.createDataFrame(grid, "k string, t double, v long")
    q = spark.createDataFrame(asked, "i int, k string, t double")
    for way in ("backward", "forward"):
        got = {r["i"]: r["v"] for r in lookup.asof(q, g, "t", ["v"], keys=["k"], direction=way).collect()}
        for i, k, t in asked:
            near = sorted((x, v) for key, x, v in grid if key == k and t is not None and (x <= t if way == "backward" else x >= t))
            assert got[i] == (None if not near else near[-1 if way == "backward" else 0][1])


def test_inversions():
    rng = np.random.default_rng(2)
    t, e, n = rng.integers(0, 9, 200), rng.random(200), rng.random(200)
    want = sum(e[i] * n[:i][t[:i] > t[i]].sum() for i in range(200))
    assert ranking.inversions(t, e, n) == pytest.approx(want)


def test_exact_mean_does_not_depend_on_order(spark):
    values = [0.1 * k for k in range(1, 10)] * 50
    got = [spark.createDataFrame([(v,) for v in rows], "x double").repartition(n).agg(summaries.exact_mean(F.col("x"))).first()[0]
           for rows, n in ((values, 1), (values[::-1], 7), (sorted(values), 3))]
    assert got == [0.5, 0.5, 0.5]


def test_running_totals_by_key(spark, size):
    rows = [(k, float(v), v) for k in range(3) for v in range(1, 40 * (k + 1))]
    df = spark.createDataFrame(rows, "k int, t double, w long").persist()
    for down in (False, True):
        run = prefix.running_totals(prefix.cut(df, "t"), ["t"], {"s": "w"}, ["k"], descending=down)
        for r in run.collect():
            mine = [w for k, t, w in rows if k == r["k"] and (t >= r["t"] if down else t <= r["t"])]
            assert r["s"] == sum(mine)


def test_quantiles_and_ranks(spark, size):
    rng = np.random.default_rng(2)
    x, k = rng.integers(0, 30, 400).astype(float), rng.integers(0, 3, 400)
    df = spark.createDataFrame(list(zip(k.tolist(), x.tolist())), "k int, x double")
    got = {r["k"]: (r["a"], r["b"]) for r in prefix.grouped_quantiles(df, ["k"], "x", {"a": .5, "b": .9}).collect()}
    for g in range(3):
        assert np.allclose(got[g], np.quantile(x[k == g], [.5, .9]))
    ranks = {r["x"]: r["r"] for r in prefix.average_ranks(df, "x", "r").collect()}
    for v, r in ranks.items():
        assert r == (x < v).sum() + ((x == v).sum() + 1) / 2


def brute_concordance(t, d, s):
    n = c = ties = 0.0
    for i in np.flatnonzero(d == 1):
        m = (t > t[i]) | ((t == t[i]) & (d == 0))
        n, c, ties = n + m.sum(), c + (s[m] < s[i]).sum(), ties + (s[m] == s[i]).sum()
    return n, c, ties


def test_concordance_with_ties(spark, size):
    rng = np.random.default_rng(3)
    t, d, s = rng.integers(1, 25, 300).astype(float), rng.integers(0, 2, 300), np.round(rng.normal(size=300), 1)
    t[:100] = 7.0  # a third of all rows share one time
    df = spark.createDataFrame(list(zip(t.tolist(), d.tolist(), s.tolist())), "time double, status int, s double")
    r = survival.concordance(df, "s").first()
    n, c, ties = brute_concordance(t, d, s)
    assert (r["comparable"], r["concordant"], r["tied"]) == (n, c, ties)
    assert r["concordance"] == pytest.approx((c + ties / 2) / n)


def test_partial_loglik_and_breslow_with_ties(spark, size):
    rng = np.random.default_rng(4)
    t, d, e, w = rng.integers(1, 20, 200).astype(float), rng.integers(0, 2, 200), rng.normal(size=200), rng.random(200)
    df = spark.createDataFrame(list(zip(t.tolist(), d.tolist(), e.tolist(), w.tolist())), "time double, status int, e double, w double")
    want = sum(e[i] - np.log(np.exp(e[t >= t[i]]).sum()) for i in np.flatnonzero(d))
    assert survival.partial_loglik(df, "e").first()[0] == pytest.approx(want)
    got = survival.breslow(df, "e", "w").orderBy("time").collect()
    times = np.unique(t[d == 1])
    jump = np.array([w[(t == x) & (d == 1)].sum() / (w * np.exp(e))[t >= x].sum() for x in times])
    assert np.allclose([r["jump"] for r in got], jump) and np.allclose([r["cumhaz"] for r in got], np.cumsum(jump))


def test_baseline_guards(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 1)], "time double, status int")
    steps = survival.hazard_steps(survival.time_table(df, 1.0, F.exp(F.lit(-5.0))))
    assert max(r["jump"] for r in steps.collect()) <= 10
    assert survival.guard_counts(steps).first()["max_jump"] == 3
    assert survival.breslow(df, 0.0, F.lit(0.0)).count() == 0
    tiny = spark.createDataFrame([(1.0, 1, 1e-9), (2.0, 1, 0.0)], "time double, status int, w double")
    assert survival.guard_counts(survival.hazard_steps(survival.time_table(tiny, "w", "w"))).first()["denom_floor"] == 1


def test_kaplan_meier_reaches_zero(spark, size):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, 1)], "time double, status int")
    got = [r["surv"] for r in survival.kaplan_meier(df).orderBy("time").collect()]
    assert np.allclose(got, [2 / 3, 2 / 3, 0])


def test_folds_are_balanced(spark):
    df = spark.createDataFrame([(i, int(i >= 60)) for i in range(100)], "id long, status int")
    f = resample.stratified_folds(df, 4, 1)
    assert {r["n"] for r in f.where("status = 1").groupBy("fold").agg(F.count("*").alias("n")).collect()} == {10}
    assert {r["n"] for r in f.where("status = 0").groupBy("fold").agg(F.count("*").alias("n")).collect()} == {15}


def test_permutation_keeps_pairs(spark):
    df = spark.createDataFrame([(i, float(i), i % 2, i * 10.0) for i in range(50)], "id long, time double, status int, x double")
    p = resample.permute_outcome(df, 5).toPandas()
    assert sorted(zip(p.time, p.status)) == [(float(i), i % 2) for i in range(50)]
    assert (p.x == p.id * 10).all() and (p.time != p.id).sum() > 30


def test_least_squares_interval(spark):
    rng = np.random.default_rng(6)
    x, z = rng.normal(size=60), rng.normal(size=60)
    y = 1 + 2 * x - z + rng.normal(size=60)
    df = spark.createDataFrame(list(zip(x.tolist(), z.tolist(), y.tolist())), "x double, z double, y double")
    fit = summaries.least_squares(df, F.col("y"), {"x": F.col("x"), "z": F.col("z")})
    want = np.linalg.lstsq(np.column_stack([np.ones(60), x, z]), y, rcond=None)[0]
    assert np.allclose(fit["estimate"], want)
    assert summaries.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)


def test_scalars():
    assert check_scalar(2, "K", lower=1, integer=True) == 2
    for bad in (0, 1.5, float("nan"), True, None, "2"):
        with pytest.raises(InputError):
            check_scalar(bad, "K", lower=1, integer=True)

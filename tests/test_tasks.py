"""Fits inside tasks against the passes over the cluster."""

import warnings

import numpy as np
import pytest

from mixhaz import cross_validate, fit_gated, fit_mixture, heterogeneity_test
from mixhaz.plans import tasks
from mixhaz.plans.model import GuardWarning

FEATS = ["f1", "f2", "f3"]
SHORT = {"tol": 1e-6, "max_iter": 6, "nstart": 9, "ident": "id"}


@pytest.fixture(autouse=True)
def quiet():
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        yield


def same(a, b):
    assert np.allclose(a.beta, b.beta, atol=1e-10) and np.allclose(a.loglik, b.loglik, rtol=1e-12) and np.allclose(a.pi, b.pi, atol=1e-10)
    assert a.final_score == pytest.approx(b.final_score, rel=1e-12) and a.converged == b.converged and a.cox_reason == b.cox_reason
    assert np.allclose(a.baselines[0].at([20, 60, 150]), b.baselines[0].at([20, 60, 150]))
    assert {g: list(v) for g, v in a.guards.items()} == {g: list(v) for g, v in b.guards.items()}


@pytest.mark.parametrize("options", [{"k": 1}, {"k": 2}, {"k": 3, "baseline": "cluster", "covariance": "full"}, {"k": 2, "init": "random", "n_starts": 2, "seed": 5},
                                     {"k": 2, "alpha": 0.5, "lam": 0.2}])
def test_fit(study, options):
    df, _ = study
    same(fit_mixture(df, FEATS, **SHORT, **options), fit_mixture(df, FEATS, task_cells=0, **SHORT, **options))


def test_gated_fit(study):
    df, _ = study
    a, b = fit_gated(df, FEATS, **SHORT), fit_gated(df, FEATS, task_cells=0, **SHORT)
    same(a, b)
    assert np.allclose(a.gate, b.gate, atol=1e-8) and np.allclose(a.pen_loglik, b.pen_loglik)


def test_folds(study):
    df, _ = study
    a, b = (cross_validate(df, FEATS, ks=(1, 2), nfolds=3, criterion="joint", seed=4, task_cells=c, **SHORT) for c in (None, 0))
    assert np.allclose(a.matrix, b.matrix, rtol=1e-10) and a.converged == b.converged


def test_fresh_seed_of_folds(study):
    df, _ = study
    a, b = (cross_validate(df, FEATS, ks=(1,), nfolds=2, seed=None, **SHORT) for _ in range(2))
    assert a.seed != b.seed and not np.allclose(a.matrix, b.matrix)
    again = cross_validate(df, FEATS, ks=(1,), nfolds=2, seed=a.seed, **SHORT)
    assert np.allclose(a.matrix, again.matrix)


@pytest.mark.parametrize("options", [{}, {"k0": 2}, {"null": "permutation"}, {"statistic": "cv", "null": "permutation", "nfolds": 2},
                                     {"statistic": "cv", "nfolds": 2, "criterion": "joint"}, {"init": "random", "n_starts": 2}])
def test_null_data_sets(study, options):
    """Observed and null statistics of both ways agree: the same draws, starts and fits."""
    df, _ = study
    a, b = (heterogeneity_test(df, FEATS, b=3, seed=7, task_cells=c, **SHORT, **options) for c in (None, 0))
    assert a.statistic == pytest.approx(b.statistic, rel=1e-8) and np.allclose(a.null_distribution, b.null_distribution, rtol=1e-7, atol=1e-7)
    assert (a.p_value, a.n_fits, a.n_not_converged) == (b.p_value, b.n_fits, b.n_not_converged)


def test_one_warning_for_the_bounds_of_all_fits(study):
    from mixhaz import Control

    df, _ = study
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        heterogeneity_test(df, FEATS, b=2, control=Control(eta_cap=0.1), **SHORT)
    told = [w for w in seen if issubclass(w.category, GuardWarning)]
    assert len(told) == 1 and "eta_cap" in str(told[0].message)


def test_bound_of_the_risk_is_counted(study):
    from mixhaz import Control

    df, _ = study
    for c in (None, 0):
        m = fit_mixture(df, FEATS, task_cells=c, control=Control(eta_clamp=0.05), **SHORT)
        assert m.guards["eta_clamp"][1] > 0


def test_many_events_are_needed(study):
    df, _ = study
    few = df.where("status = 0").unionByName(df.where("status = 1").limit(1))
    with pytest.raises(RuntimeError, match="usable"):
        heterogeneity_test(few, FEATS, b=2, **SHORT)


def test_size_decides():
    assert tasks.fits_one_task(100, 20, 2000) and not tasks.fits_one_task(101, 20, 2000)


def test_draws_of_a_task_are_those_of_the_column(spark):
    """Identifiers of all lengths, negative, or null; seeds short and too long for one block."""
    from pyspark.sql import functions as F

    from mixhaz.functions.exprs import hash_uniform
    from mixhaz.functions.hashed import hash_uniforms

    ids = [0, 7, -3, 12345, 10**9, 2**53, -(2**53)]
    rows = spark.createDataFrame([(i,) for i in [*ids, None]], "id long")
    seeds = ["boot1e", "x" * 50]
    got = rows.select("id", *[hash_uniform(s, F.lit(7), "id").alias(f"u{i}") for i, s in enumerate(seeds)]).collect()
    known = [r for r in got if r["id"] is not None]
    lone = [r for r in got if r["id"] is None]
    found = hash_uniforms([f"{s}|7" for s in seeds], np.array([*(r["id"] for r in known)]))
    assert found.tolist() == [[r[f"u{i}"] for r in known] for i in range(2)]
    assert hash_uniforms([f"{s}|7" for s in seeds], np.array([float("nan")])).ravel().tolist() == [lone[0]["u0"], lone[0]["u1"]]


def test_replicates_draw_inside_their_task(study, monkeypatch):
    """No table of (replicate, row): neither written nor dealt out."""
    from mixhaz.sources import durable

    df, _ = study

    def written(*_):
        raise AssertionError("a table was written")

    monkeypatch.setattr(durable, "durable", written)
    monkeypatch.setattr(tasks, "durable", written, raising=False)
    assert heterogeneity_test(df, FEATS, b=3, seed=7, **SHORT).n_valid == 3


def test_rows_come_some_at_a_time(study, monkeypatch):
    df, _ = study
    whole = fit_mixture(df, FEATS, **SHORT, k=2)
    monkeypatch.setattr(tasks, "ROWS_AT_A_TIME", 37)
    same(whole, fit_mixture(df, FEATS, **SHORT, k=2))
    a, b = (cross_validate(df, FEATS, ks=(1, 2), nfolds=3, seed=4, task_cells=c, **SHORT) for c in (None, 0))
    assert np.allclose(a.matrix, b.matrix, rtol=1e-10)


def test_orders_at_six_times_fit_one_task():
    assert tasks.fits_one_task(900_000, 13) and not tasks.fits_one_task(9_000_000, 13)


@pytest.mark.parametrize("k", [2, 3])
def test_leaves_assign_like_rows(k):
    """Rows on the border of two centers, equal rows and a last run that is not full, in either order."""
    from mixhaz.plans import kernels

    rng = np.random.default_rng(k)
    z = np.round(rng.normal(size=(3, 1000)) * 8) / 8  # products are exact
    centers = np.round(rng.normal(size=(6, k, 3)) * 4) / 4
    view = kernels.View(0, z.T, np.zeros(1000, int), np.zeros(1000), np.zeros(1000, int), None, None, None)
    view.memo = {("z", None, None): (None, z.T)}
    want, _ = kernels.lloyd({"hold": None, "restarts": centers}, view)
    order = tasks.near_together(z.T)
    assert sorted(order) == list(range(1000))
    for rows in (z, z[:, order]):
        assert np.allclose(kernels.lloyd_by_leaves(centers, kernels.Leaves(rows)), want, rtol=1e-12)


def test_fits_in_tasks_look_at_runs_of_like_rows(study, monkeypatch):
    """Every fit inside a task gets its rows in runs; without them k-means by leaves is slower than by rows."""
    from mixhaz.plans import kernels

    df, _ = study
    seen, order = [], tasks.near_together
    monkeypatch.setattr(tasks, "near_together", lambda x: (seen.append(len(x)), order(x))[1])
    fit_mixture(df, FEATS, **SHORT, k=2)
    assert seen == [300]
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5000, 3))
    reach = [kernels.Leaves(z.T).reach.mean() for z in (x, x[order(x)])]
    assert reach[1] < reach[0] / 2

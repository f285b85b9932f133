"""Methods on the groups of a table, and the mixture with a conjugate prior."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixhaz import fit_mixture
from mixhaz.operators.scaling import InputError
from mixhaz.plans.comparison import METHODS, compare_methods, rand_index

FEATS = ["f1", "f2", "f3"]


@pytest.fixture(autouse=True)
def quiet():
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        yield


def test_groups_are_fitted_like_single_tables(spark, study):
    df, p = study
    table = df.withColumn("site", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, F.lit(None)).otherwise("b")).withColumn("label", F.col("Z") - 1)
    few = spark.createDataFrame([("tiny", 1000 + i, 1.0 + i, 0, 0.0, 0.0, 0.0, 0) for i in range(3)], "site string, id long, time double, status int, f1 double, f2 double, f3 double, label int")
    table = table.select(few.columns).unionByName(few)
    options = {"tol": 1e-6, "max_iter": 30, "nstart": 5}
    got = {(r["site"], r["method"]): r for r in compare_methods(table, "site", FEATS, label="label", methods=list(METHODS), **options).collect()}
    assert len(got) == 4 * len(METHODS) and {s for s, _ in got} == {"a", "b", None, "tiny"}
    one = fit_mixture(table.where("site = 'a'"), FEATS, ident="id", **options)
    assert got["a", "joint"]["objective"] == pytest.approx(one.final_score, rel=1e-9)
    assert np.allclose(got["a", "joint"]["beta"], one.beta.T.ravel(), atol=1e-8)
    assert got[None, "labelled"]["ari"] == 1.0 and not any(r["failed"] for (s, _), r in got.items() if s != "tiny")
    sizes = p[p.id % 3 == 0].groupby("Z").agg(n=("status", "size"), d=("status", "sum"))
    assert got["a", "labelled"]["min_size"] == sizes.n.min() and got["a", "labelled"]["min_events"] == sizes.d.min()
    assert all(got["tiny", m]["n"] == 3 for m in METHODS) and got["tiny", "single"]["n_zero_fits"] == 1
    assert got["a", "joint_tight"]["iterations"] >= got["a", "joint"]["iterations"]


def test_large_groups_say_so(study):
    df, _ = study
    rows = compare_methods(df.withColumn("g", F.lit(1)), "g", FEATS, methods=["joint", "single"], task_cells=100).collect()
    assert [(r["failed"], r["n"]) for r in rows] == [(True, 300)] * 2 and "not for one task" in rows[0]["error"]
    with pytest.raises(InputError, match="unknown"):
        compare_methods(df, "id", FEATS, methods=["none"])


def test_large_groups_by_passes(study):
    """A group that is too large for a task gets the rows that a task would give."""
    df, _ = study
    table = df.withColumn("g", F.lit("all")).withColumn("label", F.col("Z") - 1)
    options = {"label": "label", "methods": ["single", "labelled", "two_stage", "joint"], "tol": 1e-4, "max_iter": 3, "nstart": 2}
    want = {r["method"]: r for r in compare_methods(table, "g", FEATS, **options).collect()}
    got = {r["method"]: r for r in compare_methods(table, "g", FEATS, task_cells=100, by_passes=True, **options).collect()}
    assert got.keys() == want.keys()
    for m, w in want.items():
        r = got[m]
        assert not r["failed"] and not w["failed"] and r["g"] == "all"
        assert all(r[c] == w[c] for c in ("n", "events", "min_size", "min_events", "iterations", "converged", "degenerate")), m
        assert np.allclose(r["beta"], w["beta"], atol=1e-6) and r["ari"] == pytest.approx(w["ari"])


def test_large_groups_share_their_passes(study, monkeypatch):
    """All large groups (one with a null key) and methods meet in one panel; a method without labels fails alone."""
    from mixhaz.plans import comparison

    df, _ = study
    table = df.withColumn("g", F.when(F.col("id") % 2 == 0, "even"))
    options = {"methods": ["single", "labelled", "two_stage", "features_only", "gated"], "tol": 1e-4, "max_iter": 2, "nstart": 2}
    want = {(r["g"], r["method"]): r for r in compare_methods(table, "g", FEATS, **options).collect()}
    built, build = [], comparison.build_panel
    monkeypatch.setattr(comparison, "build_panel", lambda *a, **o: (built.append(1), build(*a, **o))[1])
    got = {(r["g"], r["method"]): r for r in compare_methods(table, "g", FEATS, task_cells=100, by_passes=True, **options).collect()}
    assert built == [1] and got.keys() == want.keys() and len(got) == 10
    for key, w in want.items():
        r = got[key]
        assert all(r[c] == w[c] for c in ("n", "events", "failed", "error", "min_size", "iterations", "converged")), key
        assert w["failed"] == (key[1] == "labelled") and (w["failed"] or np.allclose(r["beta"], w["beta"], atol=1e-6))


def test_rand_index():
    assert rand_index(np.array([[5, 0], [0, 7]])) == 1.0 and abs(rand_index(np.full((2, 2), 100))) < 0.02 and rand_index(np.array([[4]])) == 1.0


@pytest.mark.parametrize("k", [2, 4])
def test_posterior_never_falls(study, k):
    """Every EM step raises the log posterior; a cluster of equal rows keeps a variance."""
    df, _ = study
    m = fit_mixture(df, FEATS, ident="id", k=k, gamma=0.0, conjugate=True, tol=1e-10, max_iter=60, nstart=5)
    assert (np.diff(m.pen_loglik) >= -1e-7 * abs(m.pen_loglik[0])).all()
    assert all((np.diag(s) > 0).all() for s in m.sigma)
    with pytest.raises(InputError, match="diagonal"):
        fit_mixture(df, FEATS, ident="id", conjugate=True, covariance="full")

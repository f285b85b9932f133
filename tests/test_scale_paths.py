"""The forms that only large inputs reach, forced on small ones."""

import warnings
from collections import Counter

import numpy as np
import pytest
from paths import SF
from pyspark.sql import functions as F

from mixhaz import fit_mixture
from mixhaz.operators import prefix
from mixhaz.plans import engine, grids, panel
from mixhaz.sources.spells import next_order, table

FEATS = ["f1", "f2", "f3"]
SHORT = {"tol": 1e-6, "max_iter": 2, "nstart": 4, "ident": "id"}


def test_hot_customers_give_the_same_next_order(spark):
    orders = table(spark, SF, "orders")
    # one customer takes a third of all orders
    skewed = orders.withColumn("o_custkey", F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.lit(1)).otherwise(F.col("o_custkey")))
    plain = next_order(skewed).select("o_orderkey", "next_date")
    split = next_order(skewed, hot_from=5).select("o_orderkey", "next_date")
    assert plain.count() == orders.count()
    assert plain.exceptAll(split).count() == 0


def test_partials_reduced_by_spark(study, monkeypatch):
    df, _ = study
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        a = fit_mixture(df, FEATS, **SHORT)
        monkeypatch.setattr(grids, "PARTIALS_ON_DRIVER", 0)
        monkeypatch.setattr(engine, "MERGE_STARTS", 0)
        monkeypatch.setattr(panel, "MIN_ROWS_PER_TASK", 40)
        monkeypatch.setattr(prefix, "SMALL_TABLE", 0)
        b = fit_mixture(df, FEATS, task_cells=0, **SHORT)
    assert np.allclose(a.beta, b.beta, atol=1e-10) and np.allclose(a.loglik, b.loglik)


def test_salted_hot_time_on_the_table_grid(study, monkeypatch):
    df, _ = study
    tied = df.withColumn("time", F.when(F.col("id") < 120, F.lit(50.0)).otherwise(F.col("time")))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        a = fit_mixture(tied, FEATS, **SHORT | {"max_iter": 1})
        build = panel.build_panel

        def small_tasks(*args, **kwargs):
            p = build(*args, **kwargs)
            p.rows_per_task = 10
            return p

        monkeypatch.setattr("mixhaz.plans.fitting.build_panel", small_tasks)
        b = fit_mixture(tied, FEATS, driver_cells=0, **SHORT | {"max_iter": 1})
    assert np.allclose(a.beta, b.beta, atol=1e-10) and np.allclose(a.loglik, b.loglik)


def test_fits_in_batches_equal_fits_at_once(study, monkeypatch):
    """Ten fold fits that do not fit on the driver together: numbers stay unique, scores the same."""
    from mixhaz.plans.fitting import cross_validate

    df, _ = study
    options = {"ks": (1, 2), "nfolds": 5, "criterion": "joint", "ident": "id", "tol": 1e-6, "max_iter": 2, "nstart": 4}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        whole = cross_validate(df, FEATS, **options)
        build = engine.Engine.__init__
        seen = []

        def tight(self, panel):
            build(self, panel, max(panel.grid_size.values() if isinstance(panel.grid_size, dict) else panel.grid_size) * (2 + 3) * 3)

        batches = engine.Engine.batches

        def counted(self, fits):
            out = batches(self, fits)
            seen.append(len(out))
            return out

        monkeypatch.setattr(engine.Engine, "__init__", tight)
        monkeypatch.setattr(engine.Engine, "batches", counted)
        parts = cross_validate(df, FEATS, task_cells=0, **options)
    assert max(seen) > 1
    assert np.allclose(whole.matrix, parts.matrix, atol=1e-6)
    assert len(np.unique(np.round(parts.matrix, 9))) == 10


def test_equal_rows_without_identifier_draw_different_outcomes(study):
    from mixhaz.plans.fitting import ROW_ID, with_row_id

    df, _ = study
    rows = with_row_id(df.unionByName(df), [*FEATS, "time", "status"], None)
    assert rows.count() == 600 and rows.select(ROW_ID).distinct().count() == 600


def test_trial_rows_of_a_task_are_bounded(spark, monkeypatch):
    """Tasks of the trial rows grow with the line items, whatever a shuffle's bytes say; the rows stay the same."""
    from mixhaz.plans import catalog

    key = lambda rows: sorted(map(tuple, rows))
    exact = ["cell", "rep", "method", "p", "events", "failed", "degenerate"]
    want = key(catalog.trial(spark, SF).select(*exact).collect())
    monkeypatch.setattr(catalog, "LINE_ROWS", 500, raising=False)
    got = catalog.trial(spark, SF).select(*exact, F.spark_partition_id().alias("task")).collect()
    in_task = Counter(r["task"] for r in got)
    assert key(r[:-1] for r in got) == want
    assert len(in_task) > 6 and max(in_task.values()) <= 1000


def test_passes_read_blocks_of_rows(study):
    """A pass hands Python whole blocks, and they hold the very rows of the panel."""
    from mixhaz.plans import kernels

    df, p = study
    held = panel.build_panel(df.withColumn("lab", (F.col("f1") > 0).cast("int")), FEATS, FEATS, ident="id", labels=["lab"])
    assert held.packed.count() < len(p) / 10
    got = [v for batch in held.packed.toArrow().to_batches() for v in kernels.views(batch)]
    rows = [v for batch in held.data.toArrow().to_batches() for v in kernels.views(batch)]
    for name in ("x", "slot", "d", "fold", "u", "label"):
        assert np.array_equal(*[np.concatenate([getattr(v, name) for v in part]) for part in (got, rows)])


def test_restarts_that_have_met_move_once():
    a, b = np.array([[0.0, 1.0], [2.0, 3.0]]), np.array([[0.0, 1.0], [2.0, 3.5]])
    centers, size = np.array([a, b, a[::-1], a]), np.array([[4, 6], [4, 6], [6, 4], [5, 5]])
    assert list(engine.apart(centers, size)) == [0, 1, 3]
    ends = [(5.0 + 1e-12, 2, "c"), (5.0, 7, "d"), (6.0, 1, "e")]
    assert engine.best_restart(ends)[1] == 2


@pytest.mark.parametrize("k", [2, 3])
def test_lloyd_by_hand(k):
    from mixhaz.plans import kernels

    rng = np.random.default_rng(2)
    z, centers = rng.normal(size=(500, 3)), rng.normal(size=(7, k, 3))
    v = kernels.View(0, z, np.zeros(500, int), np.zeros(500), None, None, None, None)
    fit = {"gi": np.arange(3), "gc": np.zeros(3), "gs": np.ones(3), "restarts": centers}
    got = kernels.lloyd(fit, v)[0].reshape(7, -1)
    for c, line in zip(centers, got):
        dist = ((z[:, None] - c) ** 2).sum(axis=2)
        near = dist.argmin(axis=1)
        want = [[dist.min(axis=1).sum()], np.bincount(near, minlength=k), *[z[near == j].sum(axis=0) for j in range(k)]]
        assert np.allclose(line, np.concatenate(want))


def test_labels_of_several_starts_read_the_rows_once_each(study):
    """Each further column of labels adds one reading of the table, where it doubled them; labels stay the same."""
    from mixhaz.operators.resample import balanced_labels

    df, _ = study
    plain = df.select("id")
    nested = chained = plain
    for s in range(4):
        nested = balanced_labels(nested, 2, f"init{s}", "id", f"l{s}")
        chained = balanced_labels(chained, 2, f"init{s}", "id", f"l{s}", plain)
    reads = [d._jdf.queryExecution().optimizedPlan().collectLeaves().size() for d in (nested, chained)]
    assert reads[1] == 5 < reads[0]
    assert nested.exceptAll(chained).count() == 0


def test_replicates_with_the_same_features_share_their_starts(study):
    df, _ = study
    both = df.withColumn("rep", F.lit(0)).unionByName(df.withColumn("rep", F.lit(1)))
    held = panel.build_panel(both, FEATS, FEATS, ident="id", rep="rep")
    got = {}
    for shared in (False, True):
        held.same_features = shared
        e = engine.Engine(held)
        e.grid = grids.DriverGrid(held)
        fits = [engine.Fit(r, engine.Job(engine.Settings(nstart=4), rep=r), held) for r in (0, 1)]
        moved, sweep = [], e.sweep
        e.sweep = lambda running, *a, **k: moved.append(len(running)) or sweep(running, *a, **k)
        e.start_kmeans(fits)
        got[shared] = fits[1].centers
        assert max(moved) == (1 if shared else 2)
    assert np.allclose(got[False], got[True], atol=1e-12)


def test_seeds_that_start_alike_are_fitted_once(study, monkeypatch):
    """Starts whose k-means ends in the same clusters, in whatever order, share one EM; each gets what it gives alone."""
    from mixhaz.plans.fitting import make_settings

    df, _ = study
    held = panel.build_panel(df, FEATS, FEATS, ident="id")
    st = make_settings(2, tol=1e-6, max_iter=3, nstart=4)
    ran = []
    settle, loop = engine.Engine.start_kmeans, engine.Engine.loop

    def turned(self, fits):
        settle(self, [f for f in fits if f.job.seed == 1])
        for f in fits:
            if f.job.seed == 2:
                f.centers = fits[0].centers[::-1] + 1e-13
            elif f.job.seed == 3:
                f.centers = fits[0].centers + 0.1

    monkeypatch.setattr(engine.Engine, "start_kmeans", turned)
    monkeypatch.setattr(engine.Engine, "loop", lambda self, fits: (ran.append(len(fits)), loop(self, fits))[1])
    a, b, c = engine.Engine(held).run([engine.Job(st, seed=s) for s in (1, 2, 3)])
    lone, = engine.Engine(held).run([engine.Job(st, seed=1)])
    held.release()
    assert ran == [2, 1] and [f.job.seed for f in (a, b, c)] == [1, 2, 3] and b.id != a.id
    assert a.final_score == b.final_score == pytest.approx(lone.final_score, rel=1e-12) and np.array_equal(a.beta, b.beta)

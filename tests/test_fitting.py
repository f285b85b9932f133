"""The EM engine against independent calculations, and the two forms of its time grid."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixhaz import Control, InputError, cross_validate, fit_gated, fit_mixture, heterogeneity_test, permutation_test
from mixhaz.operators.survival import partial_loglik
from mixhaz.plans import kernels
from mixhaz.plans.engine import Engine, Fit, Job
from mixhaz.plans.fitting import make_settings
from mixhaz.plans.grids import DriverGrid
from mixhaz.plans.inference import null_outcomes, p_value, with_row_id
from mixhaz.plans.model import NotConvergedWarning
from mixhaz.plans.panel import build_panel

FEATS = ["f1", "f2", "f3", "f4"]
QUICK = {"tol": 1e-6, "max_iter": 25, "nstart": 5}


@pytest.fixture(autouse=True)
def quiet():
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        yield


def golden_fit(gamma, temp):
    """The hand-computed two-cluster example: three rows, one feature, fixed parameters."""
    eta = np.array([[.1, -.3], [-.2, .5], [.4, 0.]])
    inv = np.array([[[1.0]], [[1 / math.sqrt(2)]]])
    par = {"beta": np.eye(2), "empty": np.zeros(2, bool), "log_pi": np.log([.4, .6]), "mu": np.array([[-.5], [1.0]]),
           "inv": inv, "logdet": np.log([1.0, 2.0]), "scale": 1.0}
    fit = {"gi": [0], "gc": np.zeros(1), "gs": np.ones(1), "ci": [1, 2], "cc": np.zeros(2), "cs": np.ones(2), "tau": par,
           "cap": 12.0, "gamma": gamma, "grids": {"old": np.array([[.2, .2, .7]]), "old_jump": np.array([[.2, 0, .5]])}}
    v = kernels.View(0, np.column_stack([[-1, .5, 2], eta]), np.arange(3), np.array([1.0, 0, 1]), None, None, None, None)
    return kernels.softmax(kernels.evidence(fit, v)[0], temp)[:, 0]


@pytest.mark.parametrize("gamma, temp, want", [
    (1, 1, [.758273633060432, .418144902477907, .053243368673719]),
    (0, 1, [.693409655058754, .378389049476261, .050503389011044]),
    (2, 1, [.813113223087430, .458993483621453, .056123214851056]),
    (1, 2, [.639136660351624, .458794488653990, .191687174032211])])
def test_membership_by_hand(gamma, temp, want):
    assert np.allclose(golden_fit(gamma, temp), want, atol=1e-12)


def cox_newton(t, d, x, w, lam=0.0, efron=False):
    """Plain weighted Cox fit by Newton steps over explicit risk sets."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        r = w * np.exp(x @ b)
        g, h = -w.sum() * lam * b, w.sum() * lam * np.eye(len(b))
        for s in np.unique(t[d == 1]):
            at, dead = t >= s, (t == s) & (d == 1)
            m = dead.sum()
            g = g + (w[dead, None] * x[dead]).sum(axis=0)
            for l in range(m if efron else 1):
                c = l / m if efron else 0.0
                q = r * at - c * r * dead
                mean = q @ x / q.sum()
                n = (w[dead].mean() if efron else w[dead].sum())
                g = g - n * mean
                h = h + n * ((x * q[:, None]).T @ x / q.sum() - np.outer(mean, mean))
        b = b + np.linalg.solve(h, g)
    return b


def test_one_cluster_is_cox(study):
    df, p = study
    x = (p[FEATS] - p[FEATS].mean()).to_numpy() / p[FEATS].std(ddof=1).to_numpy()
    for lam in (0.0, 0.05):
        m = fit_mixture(df, FEATS, ident="id", k=1, lam=lam)
        want = cox_newton(p.time.to_numpy(), p.status.to_numpy(), x, np.ones(len(p)), lam)
        assert np.allclose(m.global_beta * m.hazard_scaler[1], want, atol=1e-6)
        if lam == 0:  # the shared-baseline update has the Cox fit as its fixed point
            assert np.allclose(m.beta_scaled[:, 0], want, atol=1e-3)


def test_weighted_cox_with_ties(spark, study):
    df, p = study
    tied = df.withColumn("time", F.ceil(F.col("time") / 40).cast("double")).withColumn("lab", (F.col("f1") > 0).cast("int"))
    panel = build_panel(tied, FEATS, FEATS, ident="id", labels=["lab"])
    q = tied.toPandas()
    x = (q[FEATS] - q[FEATS].mean()).to_numpy() / q[FEATS].std(ddof=1).to_numpy()
    for efron in (False, True):
        f = Fit(1, Job(make_settings(2, lam=0.0), label=0), panel)
        f.efron = efron
        e = Engine(panel)
        from mixhaz.plans.grids import DriverGrid

        e.grid = DriverGrid(panel)
        e.solve_cox([f], {1: 0.5})
        for k in (0, 1):
            s = (q.lab == k).to_numpy()
            want = cox_newton(q.time.to_numpy()[s], q.status.to_numpy()[s], x[s], np.ones(s.sum()), efron=efron)
            assert np.allclose(f.beta[:, k], want, atol=1e-6)


@pytest.mark.parametrize("options", [{}, {"baseline": "cluster", "covariance": "full"}])
def test_table_grid_equals_driver_grid(study, options):
    df, _ = study
    short = QUICK | {"max_iter": 2}
    a = fit_mixture(df, FEATS[:3], ident="id", k=2, **short, **options)
    b = fit_mixture(df, FEATS[:3], ident="id", k=2, driver_cells=0, **short, **options)
    assert np.allclose(a.beta, b.beta, atol=1e-10) and np.allclose(a.loglik, b.loglik)
    assert np.allclose(a.baselines[0].at([50, 200]), b.baselines[0].at([50, 200]))


def test_fit_properties(study):
    df, p = study
    m = fit_mixture(df, FEATS, ident="id", k=2, n_starts=2, seed=4, **QUICK)
    assert m.final_score == max(s["final_score"] for s in m.starts)
    rows = m.memberships(df).toPandas()
    assert rows.score.sum() == pytest.approx(m.final_score)
    assert np.allclose(rows[["tau_1", "tau_2"]].sum(), m.weight_sum) and np.allclose((rows.tau_1 + rows.tau_2), 1)
    assert set(rows.cluster) <= {1, 2}
    s = m.predict(df, "survival", [0.001, 50, 100]).toPandas()[["t=0.001", "t=50", "t=100"]].to_numpy()
    assert np.allclose(s[:, 0], 1, atol=1e-12) and (np.diff(s, axis=1) <= 1e-12).all()
    lp = m.predict(df, "lp").orderBy("id").toPandas().lp
    tau = m.predict(df, "tau").orderBy("id").toPandas()[["tau_1", "tau_2"]].to_numpy()
    p = p.sort_values("id")
    z = (p[FEATS].to_numpy() - m.hazard_scaler[0]) / m.hazard_scaler[1]
    assert np.allclose(lp, (tau * (z @ m.beta_scaled)).sum(axis=1))
    assert set(m.summary()["contrast"]) == set(FEATS) and "Mixture" in repr(m)
    g = fit_mixture(df, FEATS, ident="id", k=2, gamma=0.0, **QUICK)
    a, b = [d.orderBy("id").toPandas().tau_1 for d in (g.predict(df), g.memberships(df))]
    assert np.allclose(a, b, atol=1e-6)


def test_penalised_objective_of_gate_never_falls(study):
    df, _ = study
    m = fit_gated(df, FEATS, ident="id", **QUICK)
    steps = np.diff(m.pen_loglik)
    assert (steps >= -1e-5 * abs(m.pen_loglik[0])).all() and np.allclose(m.gate.sum(axis=1), 0, atol=1e-6)
    assert fit_gated(df, FEATS, ident="id", gate_slopes=False, **QUICK).gate[1:].any() == False  # noqa: E712


def test_elastic_net_sets_zeros(study):
    df, _ = study
    m = fit_mixture(df, FEATS, ident="id", k=2, alpha=1.0, lam=0.4, **QUICK)
    assert (m.beta_scaled == 0).any()


def test_names_survive(spark, study):
    df, _ = study
    odd = ["IgG3 AMA-1 MFI | V20", "IgG1 CSP-C (delta)", "Age at V5.1", "x-y|z w"]
    renamed = df.select("time", "status", *[F.col(f).alias(o) for f, o in zip(FEATS, odd)])
    m = fit_mixture(renamed, odd, k=2, **QUICK | {"max_iter": 2})
    assert list(m.coef()) == odd and m.predict(renamed, "lp").count() == 300
    assert m.memberships(renamed).count() == 300


def test_bad_inputs(spark, study):
    df, _ = study
    bad = {"status": F.col("status") + 1, "time": -F.col("time"), "f1": F.lit(None).cast("double"), "f2": F.lit(float("inf"))}
    for c, e in bad.items():
        with pytest.raises(InputError):
            fit_mixture(df.withColumn(c, e), FEATS)
    with pytest.raises(InputError, match="no events"):
        fit_mixture(df.withColumn("status", F.lit(0)), FEATS)
    with pytest.raises(InputError, match="f1"):
        fit_mixture(df.withColumn("f1", F.lit(None).cast("double")), FEATS)
    for opts in ({"k": 0}, {"k": 1.5}, {"gamma": -1.0}, {"alpha": 2.0}, {"lam": None}, {"init": "outcome"},
                 {"control": Control(max_jump=0)}, {"baseline": "other"}, {"nonsense": 1}):
        with pytest.raises(InputError):
            fit_mixture(df, FEATS, **opts)
    with pytest.raises(InputError, match="duplicated"):
        fit_mixture(df, ["f1", "f1"])
    with pytest.raises(InputError, match="numeric"):
        fit_mixture(df.withColumn("f1", F.lit("a")), FEATS)


def test_cap_warns(study):
    df, _ = study
    with pytest.warns(NotConvergedWarning):
        fit_mixture(df, FEATS, ident="id", tol=0.0, max_iter=1, nstart=2)


def test_cross_validation_identity(spark, study):
    """Each entry is l(all) - l(train) at the linear predictor of the training fit."""
    df, _ = study
    cv = cross_validate(df, FEATS, ident="id", ks=(1, 2), nfolds=3, criterion="joint", seed=2, **QUICK)
    assert cv.totals[2] == pytest.approx(cv.components["partial"][2] + cv.components["gmm"][2])
    from mixhaz.operators.resample import stratified_folds

    rows = with_row_id(df, [*FEATS, "time", "status"], "id")
    rows = stratified_folds(rows, 3, "fold2", "_row_id")
    train = rows.where("fold <> 1")
    m = fit_mixture(train, FEATS, ident="_row_id", k=1, **QUICK)
    lp = m.predict(rows, "lp")
    want = partial_loglik(lp, "lp").first()[0] - partial_loglik(lp.where("fold <> 1"), "lp").first()[0]
    assert cv.partial[1, 1] == pytest.approx(want, abs=1e-4)
    held = rows.where("fold = 1")
    assert cv.gmm[1, 1] == pytest.approx(held.agg(F.sum(m.feature_logdens(held))).first()[0], abs=1e-4)


def test_names_of_survival_columns():
    from mixhaz.plans.model import survival_names

    assert survival_names([50.0, 0.001, 12341.0, 100000.0, 1234567.0]) == ["t=50", "t=0.001", "t=12340", "t=1e+05", "t=1235000"]
    assert survival_names([365.21, 365.24, 10.0]) == ["t=365.21", "t=365.24", "t=10"]


def test_p_value():
    assert p_value(1.0, [0.5, 1.0, 2.0, float("nan")]) == (3 / 4, 3)


def test_subgroup_tests(study):
    df, _ = study
    args = {"cluster_vars": FEATS, "ident": "id"} | QUICK | {"max_iter": 4}
    t = heterogeneity_test(df, b=3, **args)
    assert t.n_fits == 2 * 3 + 3 and len(t.null_distribution) == 3
    assert t.p_value == pytest.approx((1 + sum(v >= t.statistic for v in t.null_distribution)) / 4)
    again = heterogeneity_test(df, b=2, observed=t, **args)
    assert again.statistic == t.statistic
    with pytest.raises(InputError, match="same data"):
        heterogeneity_test(df.where("id < 200"), b=2, observed=t, **args)
    with pytest.raises(InputError, match="gamma = 1"):
        heterogeneity_test(df, gamma=2.0, **args)
    with pytest.raises(InputError, match="K0 >= 2"):
        heterogeneity_test(df, k0=2, null="permutation", **args)
    with pytest.warns(DeprecationWarning):
        p = permutation_test(df, n_perm=2, nfolds=2, null="permutation", **args)
    assert p.statistic_type == "cv" and p.n_fits is None


def test_bootstrap_reproduces_the_model(spark):
    from mixhaz.operators.simulate import simulate

    df = simulate(spark, 1500, 3, 0.0, 0.0, k_true=1, seed=5).persist()
    feats = ["f1", "f2", "f3"]
    m = fit_mixture(df, feats, ident="id", k=1, lam=0.0)
    rows = with_row_id(df, [*feats, "time", "status"], "id")
    null = null_outcomes(rows, 10, "bootstrap", 1, m).persist()
    assert null.count() == 15000
    rate, seen = null.agg(F.avg("status")).first()[0], df.agg(F.avg("status")).first()[0]
    assert abs(rate - seen) < 0.03
    back = fit_mixture(null, feats, k=1, lam=0.0)
    assert np.abs(back.beta - m.beta).max() < 0.05
    two = fit_mixture(df, feats, ident="id", k=2, **QUICK)
    drawn = null_outcomes(rows, 2, "bootstrap", 1, two)
    assert abs(drawn.agg(F.avg("status")).first()[0] - seen) < 0.06


def test_every_kmeans_restart_runs_to_its_end(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.45, (25, 2)) for c in [(0, 0), (0, 3), (3, 0), (3, 3), (6, 1), (7, 5), (1, 7), (4, 8)]])
    df = spark.createDataFrame([(i, float(i + 1), i % 2, float(a), float(b)) for i, (a, b) in enumerate(x)],
                               "id int, time double, status int, f1 double, f2 double")

    def ended(c):
        while True:
            near = ((z[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([z[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
            if np.array_equal(new, c):
                return ((z - c[near]) ** 2).sum()
            c = new

    panel = build_panel(df, ["f1", "f2"], ["f1"], "time", "status", "id")
    st = make_settings(8, nstart=12)
    engine = Engine(panel)
    fits = [Fit(i, Job(st, seed=i + 1), panel) for i in range(12)]
    engine.grid = DriverGrid(panel)
    z = (x - fits[0].gc) / fits[0].gs
    starts, sweep = {}, engine.sweep

    def watched(running, kernel, *args, **kwargs):
        for f in running:
            starts.setdefault(f.id, f.restarts.copy())
        return sweep(running, kernel, *args, **kwargs)

    engine.sweep = watched
    engine.start_kmeans(fits)
    for f in fits:
        got = ((z[:, None] - f.centers) ** 2).sum(axis=2).min(axis=1).sum()
        assert math.isclose(got, min(ended(c) for c in starts[f.id]), rel_tol=1e-9)

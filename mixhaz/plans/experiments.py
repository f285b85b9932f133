"""Simulation studies: many data sets, several methods, one result row per data set and method.

All data sets of a study form one panel and all their fits advance together, so the
number of Spark jobs does not depend on the number of replicates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixhaz.operators.metrics import contrast_recovery
from mixhaz.operators.scaling import InputError
from mixhaz.operators.simulate import geometry, simulate_on
from mixhaz.plans import kernels
from mixhaz.plans.engine import Engine, Fit, Job
from mixhaz.plans.fitting import make_settings
from mixhaz.plans.panel import build_panel

METHODS = ("single", "two_stage", "features_only", "joint", "oracle", "gated")
RESULT_SCHEMA = (
    "cell int, rep int, method string, n long, p int, mu_sep double, beta_sep double, rho double, events long, "
    "failed boolean, error string, recovery double, ari double, mse_eta double, sharpness double, "
    "contrast_norm double, min_size double, min_events double, degenerate boolean, min_eff_size double, "
    "min_eff_events double, n_zero_fits int, converged boolean, iterations int, guard_bound boolean")


def simulated_study(rows: DataFrame, cells: Mapping[int, Mapping], p: int, k_true: int = 2, seed="study") -> DataFrame:
    """Simulate every (cell, rep, id) row under its cell's design (mu_sep, beta_sep, rho, event_rate)."""
    out = None
    for cell, design in cells.items():
        part = simulate_on(rows.where(F.col("cell") == cell), p, design["mu_sep"], design["beta_sep"], design.get("rho", 0.0),
                           k_true, design.get("event_rate", 0.55), seed=seed, ident=("cell", "rep", "id"), keys=("cell", "rep"))
        out = part if out is None else out.unionByName(part)
    return out


def run_study(rows: DataFrame, cells: Mapping[int, Mapping], p: int, k_true: int = 2, methods: Sequence[str] = METHODS,
              seed: str = "study", **options) -> DataFrame:
    """Fit every method to every replicate of every cell and score it against the truth.

    `rows` has cell, rep (unique over cells) and id. Predictions are scored on a second
    data set of the same design. Methods that fail give a row with `failed`, never no row.
    """
    unknown = [m for m in methods if m not in METHODS]
    if unknown:
        raise InputError(f"unknown method(s): {', '.join(unknown)}")
    spark = rows.sparkSession
    feats = [f"f{j + 1}" for j in range(p)]

    def panel_for(tag):
        data = simulated_study(rows, cells, p, k_true, f"{seed}{tag}").withColumn("_z", F.col("Z") - 1)
        return build_panel(data, feats, feats, "time", "status", "id", rep="rep", labels=["_z"], extra=["eta"])

    cell_of = {r["rep"]: r["cell"] for r in rows.select("cell", "rep").distinct().collect()}
    train = panel_for("train")
    engine = Engine(train)
    base = make_settings(k_true, **options)
    kinds = {"features_only": replace(base, gamma=0.0), "joint": base, "gated": replace(base, prior="gate")}
    want = [m for m in ("features_only", "joint", "gated") if m in methods or (m == "features_only" and "two_stage" in methods)]
    keys = [(r, m) for r in train.reps for m in want]
    fits = dict(zip(keys, engine.run([Job(kinds[m], rep=r) for r, m in keys])))
    if not keys:
        engine.run([Job(replace(base, k=1, max_iter=1), rep=r) for r in train.reps[:1]])

    plain: dict = {}
    number = len(fits) + 1
    for r in train.reps:
        for m in ("single", "two_stage", "oracle"):
            if m not in methods:
                continue
            k = 1 if m == "single" else k_true
            f = Fit(number, Job(replace(base, k=k, gamma=0.0), rep=r, label=0 if m == "oracle" else None), train)
            number += 1
            if m == "two_stage":
                g = fits[r, "features_only"]
                f.mode, f.par, f.base, f.pi, f.mu, f.sigma = "hard", g.par, g.base, g.pi, g.mu, g.sigma
                f.weight_sum, f.eff_events, f.sharpness = g.weight_sum, g.eff_events, g.sharpness
            plain[r, m] = f
    with np.errstate(all="ignore"):
        engine.plain_cox(list(plain.values()))
        every = {key: f for key, f in (fits | plain).items() if key[1] in methods}
        for (r, m), f in every.items():
            if m in ("features_only", "joint", "gated"):
                f.freeze(pi_min=1e-12)
                f.mode = "hard"
            f.more = {"true_k": k_true, "truth_label": 0, "truth": len(feats), "raw_beta": f.beta / f.cs[:, None]}
        tables, _ = engine.sweep(list(every.values()), kernels.contingency, grids=("old", "old_jump"))
        test = panel_for("test")
        scorer = Engine(test)
        scorer.grid = engine.grid
        errors, _ = scorer.sweep(list(every.values()), kernels.prediction_error)
    out = [_result(key, f, cell_of, cells, p, k_true, tables[f.id], errors[f.id]) for key, f in every.items()]
    train.release()
    test.release()
    return spark.createDataFrame(out, RESULT_SCHEMA)


def _result(key, f, cell_of, cells, p, k_true, table, error):
    rep, method = key
    design = cells[cell_of[rep]]
    betas, _ = geometry(p, design["mu_sep"], design["beta_sep"], k_true)
    raw = f.more["raw_beta"]
    mine = [raw[:, k] for k in range(raw.shape[1])]
    if method == "single":
        mine = mine * 2
    counts = table[: f.k * k_true].reshape(f.k, k_true)
    size, events = table[f.k * k_true:f.k * (k_true + 1)], table[f.k * (k_true + 1):]
    n, total, squares = error
    clustered = method != "single"
    norm = float(np.linalg.norm(mine[0] - mine[1])) if len(mine) > 1 else None
    soft = method not in ("single", "oracle")

    def num(x):
        return None if x is None or not np.isfinite(x) else float(x)

    failed = f.error is not None
    return (int(cell_of[rep]), int(rep), method, int(f.n), p, float(design["mu_sep"]), float(design["beta_sep"]),
            float(design.get("rho", 0.0)), int(f.events), failed, f.error,
            None if failed else num(contrast_recovery(mine, betas)), num(rand_index(counts)) if clustered else None,
            num(squares / n - (total / n) ** 2), num(f.sharpness) if soft else None, num(norm),
            num(size.min()) if clustered else None, num(events.min()) if clustered else None,
            bool((size.min() < 10) or (events.min() < 5)) if clustered else None,
            num(f.weight_sum.min()) if soft else None, num(f.eff_events.min()) if soft else None,
            int(sum(not np.any(b) for b in mine)), bool(f.converged) if f.trace else None,
            len(f.trace) if f.trace else None, bool(f.guards) if f.trace else None)


def rand_index(counts: np.ndarray) -> float:
    """Adjusted Rand index from a contingency table."""
    def pairs(a):
        return float((a * (a - 1) / 2).sum())

    both, rows, cols = pairs(counts), pairs(counts.sum(axis=1)), pairs(counts.sum(axis=0))
    n = counts.sum()
    expected = rows * cols / (n * (n - 1) / 2)
    top = (rows + cols) / 2
    return 1.0 if top == expected else (both - expected) / (top - expected)


__all__ = ["METHODS", "run_study", "simulated_study"]

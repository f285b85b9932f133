"""The two-phase sink of result cells, and the ladder of solver attempts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixhaz.operators.scaling import InputError
from mixhaz.plans import kernels, solvers, tasks
from mixhaz.plans.engine import Job
from mixhaz.plans.fitting import make_settings
from mixhaz.sources import cells


def results(spark, values):
    return spark.createDataFrame(values, "cell string, rep int, method string, x double")


def test_cells_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "res")
    assert cells.read_results(spark, path) is None
    cells.write_cells(results(spark, [("007", 1, "a", 1.0), ("007", 2, "a", 2.0), ("8", 1, "a", 3.0)]), path)
    cells.write_cells(results(spark, [("007", 1, "b", 9.0)]), path)
    assert sorted(map(tuple, cells.read_results(spark, path).collect())) == [("007", 1, "b", 9.0), ("8", 1, "a", 3.0)]
    now = {r["cell"]: r["rows"] for r in cells.manifest(spark, path).collect()}
    assert now == {"007": 1, "8": 1}
    registry = spark.createDataFrame([("007", 1), ("8", 2)], "cell string, reps int")
    assert [r["cell"] for r in cells.open_cells(registry, path).collect()] == ["8"]
    with pytest.raises(InputError, match="1 cells"):
        cells.collect_cells(registry, path)
    cells.write_cells(results(spark, [("8", 1, "a", 4.0), ("8", 2, "a", 5.0)]), path)
    assert cells.collect_cells(registry, path).count() == 3
    assert cells.drop_superseded(spark, path) == 1 and cells.collect_cells(registry, path).count() == 3


@pytest.mark.parametrize("breaks_at", ["check", "first rename", "second rename"])
def test_a_broken_write_leaves_the_old_cell(spark, tmp_path, monkeypatch, breaks_at):
    path = str(tmp_path / "res")
    cells.write_cells(results(spark, [("1", 1, "a", 1.0), ("2", 1, "a", 2.0)]), path)
    real, calls = cells._rename, []

    def broken(*args):
        calls.append(args)
        if len(calls) == (1 if breaks_at == "first rename" else 2):
            raise OSError("the machine is gone")
        real(*args)

    if breaks_at == "check":
        told = cells.fingerprints

        def lossy(rows):
            calls.append(rows)
            return told(rows if len(calls) == 1 else rows.where("x < 50"))  # a row is missing when read back

        monkeypatch.setattr(cells, "fingerprints", lossy)
    else:
        monkeypatch.setattr(cells, "_rename", broken)
    with pytest.raises(OSError):
        cells.write_cells(results(spark, [("1", 1, "a", 10.0), ("1", 2, "a", 60.0)]), path)
    monkeypatch.undo()
    assert sorted(map(tuple, cells.read_results(spark, path).collect())) == [("1", 1, "a", 1.0), ("2", 1, "a", 2.0)]
    assert cells.drop_superseded(spark, path) == (2 if breaks_at == "second rename" else 1)
    cells.write_cells(results(spark, [("1", 1, "a", 10.0)]), path)
    assert cells.read_results(spark, path).agg(F.sum("x")).first()[0] == 12.0


# ---------------------------------------------------------------- ladder of attempts, on arrays as a task runs them

def run_here(**options):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2)) + np.repeat([[0, 0], [3, 3]], 100, axis=0)
    time, status = rng.exponential(10, 200).round(1) + 0.1, rng.integers(0, 2, 200)
    data = tasks.Features(np.arange(200), rng.random(200), x, ["a", "b"], None, np.zeros(200, np.int32))
    st = make_settings(2, **({"baseline": "cluster", "max_iter": 1, "nstart": 3} | options))
    return tasks.fit_here(data, (["a", "b"], ["a", "b"]), [Job(st)], 0, time, status, data.fold, {}, False, 0, False)[0]


def failing(monkeypatch, when):
    real = solvers.penalised_step
    monkeypatch.setattr(solvers, "penalised_step", lambda beta, grad, hess, weight, lam, alpha: np.full(2, np.nan) if when(weight, lam, alpha)
                        else real(beta, grad, hess, weight, lam, alpha))


def test_first_rung(monkeypatch):
    assert run_here(alpha=0.5)["reason"] == ["ok", "ok"]


def test_second_rung_is_a_ridge_of_twice_the_penalty(monkeypatch):
    failing(monkeypatch, lambda w, lam, alpha: alpha > 0)
    got = run_here(alpha=0.5, lam=0.1)
    assert got["reason"] == ["ridge_fallback"] * 2 and all(got["ok"])
    monkeypatch.undo()
    ridge = run_here(alpha=0.0, lam=0.2)
    assert np.allclose(got["global_beta"], ridge["global_beta"], atol=1e-6)


def test_third_rung_is_the_whole_data_fit(monkeypatch):
    failing(monkeypatch, lambda w, lam, alpha: w < 199)
    got = run_here()
    assert got["reason"] == ["fallback_global_failed"] * 2 and not any(got["ok"])
    assert np.allclose(got["beta"], got["global_beta"][:, None]) and got["global_beta"].any()


def test_last_rung_is_zero(monkeypatch):
    failing(monkeypatch, lambda w, lam, alpha: True)
    got = run_here()
    assert not got["beta"].any() and not got["global_beta"].any()


def test_used_up_steps_are_a_failure(monkeypatch):
    real = solvers.Ascent.__init__
    monkeypatch.setattr(solvers.Ascent, "__init__", lambda self, beta, lam, alpha, close=1e-8, limit=50: real(self, beta, lam, alpha, 0.0, 2))
    got = run_here()
    assert got["reason"] == ["fallback_global_failed"] * 2


def test_unsettled_gate_is_not_converged(monkeypatch):
    real = kernels.gate_score

    def wobbling(fit, v):
        vec, rest = real(fit, v)
        return np.concatenate([vec[:2], vec[2:2 + 6] + 50.0 * np.array([0, 1, 0, 0, -1, 0]), vec[8:]]), rest

    monkeypatch.setattr(kernels, "gate_score", wobbling)
    got = run_here(prior="gate", baseline="shared", max_iter=3, tol=1.0)
    assert not got["converged"] and got["gate_reason"] == "gate still moving"

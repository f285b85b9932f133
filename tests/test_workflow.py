"""Reading, roles, workflow, simulation, durable results, streaming, plots."""

import json
import math
import os
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixhaz import InputError, beta_heatmap, final_model, fit_mixture, fit_model, read_data, run_cv
from mixhaz.operators.simulate import simulate, truth
from mixhaz.plans.selftest import selftest
from mixhaz.sources import cells as cells_of
from mixhaz.operators.simulate import geometry
from mixhaz.plans import experiments
from mixhaz.streaming.scoring import score_stream, write_scores

QUICK = {"tol": 1e-4, "max_iter": 4, "nstart": 3}


@pytest.fixture(autouse=True)
def quiet():
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        yield


@pytest.fixture(scope="module")
def files(tmp_path_factory, spark):
    d = tmp_path_factory.mktemp("files")
    rows = [(0.5 * i, (i * 7) % 11 / 3.0, i % 2, float(i % 13 + 1), int(i % 3 > 0)) for i in range(40)]
    head = ["m one", "m|2", "arm", "t", "d"]
    for name, sep in (("a.csv", ","), ("a.tsv", "\t")):
        (d / name).write_text("\n".join([sep.join(head)] + [sep.join(map(str, r)) for r in rows]))
    (d / "a.txt").write_text("\n".join(["m1  m2 arm t d"] + ["  ".join(map(str, r)) for r in rows]))
    spark.createDataFrame(rows, head).write.parquet(str(d / "a.parquet"))
    (d / "a.json").write_text("\n".join(json.dumps(dict(zip(head, r))) for r in rows))
    return d


@pytest.mark.parametrize("name", ["a.csv", "a.tsv", "a.txt", "a.parquet", "a.json"])
def test_formats(spark, files, name):
    p = read_data(spark, str(files / name), "t", "d", "arm")
    assert (p.dim, p.numdata, p.events) == (2, 40, 26)
    assert p.indicators == ["arm"] and "arm" not in p.features
    z = p.standardised().agg(F.avg(F.col(f"`{p.features[0]}`")), F.max("arm")).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == 1


def test_roles_and_errors(spark, files):
    path = str(files / "a.csv")
    assert read_data(spark, path, 4, 5).dim == 3
    for args in ((9, 5), ("t", "nope"), ("t", "t"), ("t", "d", "t")):
        with pytest.raises(InputError):
            read_data(spark, path, *args)
    for f in ("x.rds", "x.unknown"):
        with pytest.raises(InputError):
            read_data(spark, f, "t", "d")
    import pandas as pd

    assert read_data(spark, pd.read_csv(path), "t", "d").numdata == 40


def test_workflow(spark):
    df = simulate(spark, 200, 3, 2.0, 2.0, seed=9).select("f1", "f2", "f3", (F.col("id") % 2).cast("int").alias("arm"), "time", "status").persist()
    p = read_data(spark, df, "time", "status", "arm")
    cv = run_cv(p, (1, 2), 3, varcox=["f1", "f2"], **QUICK)
    assert cv.matrix.shape == (3, 2) and cv.best_k in (1, 2)
    assert np.allclose(cv.matrix.sum(axis=0), list(cv.totals.values()))
    m = final_model(cv, p, varcox=["f1", "f2"], nseeds=2, **QUICK)
    assert m.extras["k_selected"] == cv.best_k and m.hazard_vars == ["f1", "f2", "arm"] and m.cluster_vars == ["f1", "f2", "f3"]
    assert 0.4 < m.metrics["cindex"] < 1
    assert fit_model(p, 1, vargmm=[1], nseeds=1, **QUICK).cluster_vars == ["f1"]
    assert len(m.plot_data("trace")) == m.iterations and m.plot_data("tau").agg(F.sum("n")).first()[0] == 200


def test_heatmap(tmp_path):
    assert (beta_heatmap(np.arange(4).reshape(2, 2)) == np.arange(4).reshape(2, 2)).all()
    out = str(tmp_path / "h.svg")
    beta_heatmap([[1.0, -1.0]], out, rows=["a<b"])
    assert "a&lt;b" in open(out).read() and os.path.getsize(out) > 200
    with pytest.raises(InputError):
        beta_heatmap([[1.0]], "h.png")


def test_geometry():
    b, m = geometry(10, 1.0, 2.0, 2)
    v, u = b[1] - b[0], m[1] - m[0]
    assert np.linalg.norm(v) == pytest.approx(2) and np.linalg.norm(u) == pytest.approx(1)
    assert v @ u == pytest.approx(0, abs=1e-12) and np.linalg.norm(b[0]) == pytest.approx(np.linalg.norm(b[1]))
    b, _ = geometry(10, 1.0, 2.0, 3)
    assert all(np.linalg.norm(b[i] - b[j]) == pytest.approx(2) for i in range(3) for j in range(i))
    assert len(truth(4, 1.0, 1.0)) == 2


def test_simulator(spark):
    s = simulate(spark, 20000, 6, 1.0, 2.0, event_rate=0.4, seed=2).persist()
    assert s.agg(F.avg("status")).first()[0] == pytest.approx(0.4, abs=0.01)
    assert s.agg(F.min("time")).first()[0] >= 0.1
    log = simulate(spark, 20000, 6, 0.0, 2.0, features="lognormal", seed=2).agg(F.stddev("f2"), F.skewness("f2")).first()
    assert log[0] == pytest.approx(1, abs=0.1) and log[1] > 2
    rho = simulate(spark, 20000, 4, 0.0, 1.0, rho=0.5, seed=2).agg(F.corr("f1", "f2")).first()[0]
    assert rho == pytest.approx(0.5, abs=0.03)
    assert simulate(spark, 500, 6, 1.0, 2.0, censoring="administrative", followup=150.0).agg(F.max("time")).first()[0] <= 150
    for bad in ({"k_true": 4}, {"k_true": 3}, {"features": "lognormal", "rho": 0.2}, {"censoring": "administrative"}):
        with pytest.raises(InputError):
            simulate(spark, 10, 4, 1.0, 1.0, **bad)


def test_study_and_durable_results(spark, tmp_path):
    rows = spark.range(900).select((F.col("id") % 3).cast("int").alias("rep"), "id").withColumn("cell", F.pmod("rep", F.lit(2)))
    cells = {0: {"mu_sep": 2.0, "beta_sep": 3.0}, 1: {"mu_sep": 0.5, "beta_sep": 1.0}}
    got = experiments.run_study(rows, cells, 4, **QUICK | {"max_iter": 15}).persist()
    table = {(r["rep"], r["method"]): r for r in got.collect()}
    assert len(table) == 3 * len(experiments.METHODS) and not any(r["failed"] for r in table.values())
    assert table[0, "oracle"]["ari"] == 1.0 and table[0, "oracle"]["recovery"] > 0.9
    assert table[0, "single"]["recovery"] == pytest.approx(math.sqrt(2 / (math.pi * 4)))
    assert table[0, "oracle"]["mse_eta"] < table[0, "single"]["mse_eta"]
    path = str(tmp_path / "res")
    registry = spark.createDataFrame([(0, 2), (1, 1)], "cell int, reps int")
    assert cells_of.read_results(spark, path) is None and cells_of.open_cells(registry, path).count() == 2
    cells_of.write_cells(got.where("cell = 0"), path)
    assert [r["cell"] for r in cells_of.open_cells(registry, path).collect()] == [1]
    with pytest.raises(InputError):
        cells_of.collect_cells(registry, path)
    cells_of.write_cells(got.where("cell = 1"), path)
    assert cells_of.collect_cells(registry, path).count() == got.count()


def test_stream_scoring(spark, tmp_path, study):
    df, _ = study
    m = fit_mixture(df, ["f1", "f2"], ident="id", **QUICK)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.select("id", "f1", "f2").repartition(3).write.parquet(src)
    stream = spark.readStream.schema("id long, f1 double, f2 double").parquet(src)
    write_scores(score_stream(m, stream, "lp"), out, str(tmp_path / "chk")).awaitTermination(120)
    batch = {r["id"]: r["lp"] for r in m.predict(df.select("id", "f1", "f2"), "lp").collect()}
    assert {r["id"]: r["lp"] for r in spark.read.parquet(out).collect()} == pytest.approx(batch)
    with pytest.raises(ValueError):
        score_stream(m, df)


def test_selftest(spark):
    ok, checks = selftest(spark)
    assert ok, checks

"""Checks a user can run on their own installation."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from mixhaz.operators.simulate import geometry, simulate
from mixhaz.operators.survival import cumhaz_at
from mixhaz.plans.fitting import fit_mixture


def selftest(spark: SparkSession) -> tuple[bool, list[dict]]:
    """Lookup before the first step, agreement of the density, K = 1 as plain Cox, order of rows, recovery."""
    out = []

    def check(name, ok, detail=""):
        out.append({"check": name, "ok": bool(ok), "detail": str(detail)})

    grid = spark.createDataFrame([(2.0, 0.1), (4.0, 0.5), (6.0, 0.9)], "time double, cumhaz double")
    asked = spark.createDataFrame([(float(t),) for t in (1, 3, 5, 7)], "time double")
    got = [r["cumhaz"] for r in cumhaz_at(asked, grid).orderBy("time").collect()]
    check("lookup before the first step is zero", got == [0.0, 0.1, 0.5, 0.9], got)

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        feats = [f"f{j + 1}" for j in range(4)]
        data = simulate(spark, 400, 4, 2.0, 3.0, seed=3).persist()
        quick = {"tol": 1e-6, "max_iter": 60, "nstart": 5}
        m = fit_mixture(data, feats, ident="id", k=2, **quick)
        rows = m.memberships(data)
        total = rows.agg(F.sum("score")).first()[0]
        check("row scores add up to the objective", abs(total - m.final_score) < 1e-6 * abs(total), total)
        again = fit_mixture(data.orderBy(F.desc("time")), feats, ident="id", k=2, **quick)
        check("the order of rows does not matter", np.allclose(m.beta, again.beta, atol=1e-8))
        one = fit_mixture(data, feats, ident="id", k=1, lam=0.0, **quick)
        flat = fit_mixture(data, feats, ident="id", k=1, lam=0.0, gamma=0.0, **quick)
        check("one cluster is a plain Cox fit, whatever gamma", np.allclose(one.beta, flat.beta, atol=1e-6)
              and np.allclose(one.beta[:, 0], one.global_beta, atol=1e-3))
        b, _ = geometry(4, 2.0, 3.0, 2)
        c, t = m.beta[:, 0] - m.beta[:, 1], b[0] - b[1]
        cos = abs(float(c @ t)) / math.sqrt(float(c @ c) * float(t @ t))
        check("the coefficient contrast is recovered", cos > 0.8, round(cos, 3))
        data.unpersist()
    return all(c["ok"] for c in out), out

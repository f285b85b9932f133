"""E-step and closed-form M-step expressions of a mixture with given parameters."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixhaz.functions.exprs import col, gaussian_log, log_sum_exp, replace_bad, total


def inverse_factor(sigma, ridge: float) -> np.ndarray:
    """Inverse Cholesky factor of sigma + ridge I; a larger ridge if that is not positive definite."""
    s = np.atleast_2d(np.asarray(sigma, float))
    try:
        low = np.linalg.cholesky(s + ridge * np.eye(len(s)))
    except np.linalg.LinAlgError:
        low = np.linalg.cholesky(s + 1e-3 * np.eye(len(s)))
    return np.linalg.inv(low)


def feature_evidence(columns: Sequence[Column], pi, mu, sigma, ridge: float = 1e-6, scale: float = 1.0,
                     pi_min: float = 0.0) -> list[Column]:
    """log pi_k + scale * log N(x; mu_k, sigma_k + ridge I) for each cluster."""
    return [F.lit(math.log(max(float(p), pi_min))) + F.lit(float(scale)) *
            gaussian_log(columns, m, inverse_factor(s, ridge)) for p, m, s in zip(pi, mu, sigma)]


def evidence_score(parts: Sequence[Column], temp: float = 1.0) -> Column:
    """Per-row objective: temp * log sum exp(evidence / temp)."""
    return log_sum_exp([p / F.lit(float(temp)) for p in parts]) * F.lit(float(temp))


def sanitise(parts: Sequence[Column]) -> list[Column]:
    return [replace_bad(p) for p in parts]


def add_memberships(df: DataFrame, parts: Sequence[Column], temp: float = 1.0, floor: float = 1e-12,
                    prefix: str = "tau_", score: str | None = None) -> DataFrame:
    """Add softmax weights `prefix`1..K of the evidence, and optionally the row objective.

    Written as a chain of small projections: each value is computed once and then
    referred to, instead of being repeated inside one large expression.
    """
    ks = range(len(parts))
    keep = [col(c) for c in df.columns]
    step = df.select("*", *[p.alias(f"_l{k}") for k, p in enumerate(parts)])
    step = step.select("*", *[(replace_bad(F.col(f"_l{k}")) / F.lit(float(temp))).alias(f"_s{k}") for k in ks])
    step = step.withColumn("_lse", log_sum_exp([F.col(f"_s{k}") for k in ks]))
    step = step.select("*", *[F.greatest(F.exp(F.col(f"_s{k}") - F.col("_lse")), F.lit(floor)).alias(f"_r{k}") for k in ks])
    step = step.withColumn("_mass", total([F.col(f"_r{k}") for k in ks]))
    extra = [] if score is None else [(F.col("_lse") * F.lit(float(temp))).alias(score)]
    return step.select(*keep, *[(F.col(f"_r{k}") / F.col("_mass")).alias(f"{prefix}{k + 1}") for k in ks], *extra)


def mixing_weights(df: DataFrame, tau: Sequence[str], floor: float = 0.02) -> DataFrame:
    """Mean membership weights, floored and renormalised (so one may end below the floor)."""
    means = df.agg(*[F.greatest(F.avg(t), F.lit(floor)).alias(f"p{k}") for k, t in enumerate(tau)])
    mass = total([F.col(f"p{k}") for k in range(len(tau))])
    return means.select(*[(F.col(f"p{k}") / mass).alias(f"pi_{k + 1}") for k in range(len(tau))])


def weighted_moments(df: DataFrame, features: Sequence[str], tau: Sequence[str], ridge: float = 1e-6) -> DataFrame:
    """Weighted mean and ridged variance of every feature in every cluster, one pass.

    Sums are taken around the plain feature values, which are standardised here.
    """
    picks = []
    for k, t in enumerate(tau):
        picks.append(F.sum(t).alias(f"w{k}"))
        for j, x in enumerate(features):
            picks += [F.sum(F.col(t) * F.col(x)).alias(f"s{k}_{j}"),
                      F.sum(F.col(t) * F.col(x) * F.col(x)).alias(f"q{k}_{j}")]
    one = df.agg(*picks)
    cells = []
    for k in range(len(tau)):
        for j, x in enumerate(features):
            mean = F.col(f"s{k}_{j}") / F.col(f"w{k}")
            cells.append(F.struct(F.lit(k + 1).alias("cluster"), F.lit(x).alias("feature"),
                                  F.col(f"w{k}").alias("weight_sum"), mean.alias("mean"),
                                  (F.col(f"q{k}_{j}") / F.col(f"w{k}") - mean * mean + F.lit(ridge)).alias("variance")))
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")

"""Recovery metrics and cluster diagnostics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def adjusted_rand(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index of two labelings, per group of `keys`."""
    def pairs(c):
        return F.col(c) * (F.col(c) - 1) / 2.0

    both = df.groupBy(*keys, a, b).agg(F.count("*").cast("double").alias("n")).persist()
    rows = both.groupBy(*keys, a).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(pairs("n")).alias("ra"))
    cols = both.groupBy(*keys, b).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(pairs("n")).alias("cb"))
    cell = both.groupBy(*keys).agg(F.sum(pairs("n")).alias("ab"), F.sum("n").alias("n"))
    if keys:
        one = cell.join(rows, list(keys)).join(cols, list(keys))
    else:
        one = cell.withColumn("ra", rows.scalar()).withColumn("cb", cols.scalar())
    expected = F.col("ra") * F.col("cb") / pairs("n")
    top = (F.col("ra") + F.col("cb")) / 2.0
    value = F.when(top == expected, F.lit(1.0)).otherwise((F.col("ab") - expected) / (top - expected))
    return one.select(*keys, value.alias("ari"))


def mse_up_to_level(df: DataFrame, pred: Column, truth: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of a linear predictor after removing the mean difference."""
    return df.groupBy(*keys).agg(F.var_pop(pred - truth).alias("mse"))


def cluster_health(df: DataFrame, cluster: str, tau: Sequence[str], k: int, keys: Sequence[str] = ()) -> DataFrame:
    """Smallest hard and effective cluster, and the degenerate flag (<10 rows or <5 events)."""
    sums = [F.sum(F.when(F.col(cluster) == c, 1).otherwise(0)).alias(f"n{c}") for c in range(1, k + 1)]
    sums += [F.sum(F.when(F.col(cluster) == c, F.col("status")).otherwise(0)).alias(f"e{c}") for c in range(1, k + 1)]
    sums += [F.sum(t).alias(f"w{i}") for i, t in enumerate(tau)]
    sums += [F.sum(F.col(t) * F.col("status")).alias(f"v{i}") for i, t in enumerate(tau)]
    one = df.groupBy(*keys).agg(*sums)

    def smallest(prefix, span):
        names = [F.col(f"{prefix}{c}") for c in span]
        return F.least(*names) if len(names) > 1 else names[0]

    hard = range(1, k + 1)
    soft = range(len(tau))
    out = one.select(*keys, smallest("n", hard).alias("min_size"), smallest("e", hard).alias("min_events"),
                     smallest("w", soft).alias("min_eff_size"), smallest("v", soft).alias("min_eff_events"))
    return out.withColumn("degenerate", (F.col("min_size") < 10) | (F.col("min_events") < 5))


def profile_direction(df: DataFrame, features: Sequence[str], group: str, pair=(1, 2)) -> DataFrame:
    """Unit direction of the difference between two groups' feature means, one row per feature."""
    a, b = pair
    diffs = [F.avg(F.when(F.col(group) == b, F.col(x))) - F.avg(F.when(F.col(group) == a, F.col(x))) for x in features]
    one = df.agg(*[d.alias(f"d{j}") for j, d in enumerate(diffs)])
    norm = F.sqrt(sum((F.col(f"d{j}") ** 2 for j in range(len(features))), F.lit(0.0)))
    cells = [F.struct(F.lit(x).alias("feature"), (F.col(f"d{j}") / norm).alias("direction")) for j, x in enumerate(features)]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def events_per_coefficient(df: DataFrame, group: str, p: int, keys: Sequence[str] = ()) -> DataFrame:
    """Events of each subgroup, the smallest, per coefficient, and the overall event rate."""
    per = df.groupBy(*keys, group).agg(F.sum("status").alias("e"), F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.min("e").alias("events_sub_min"), (F.min("e") / F.lit(p)).alias("events_per_coef"),
                                  (F.sum("e") / F.sum("n")).alias("realized_rate"))


def random_floor(p: Column | float):
    """Expected |cos| of two random directions in p dimensions."""
    if isinstance(p, Column):
        return F.sqrt(F.lit(2.0 / math.pi) / p)
    return math.sqrt(2.0 / (math.pi * p))


def contrast_span(betas: Sequence[Sequence[float]]) -> np.ndarray | None:
    """Orthonormal basis of the differences between coefficient vectors; None without any."""
    if len(betas) < 2:
        return None
    b = np.column_stack([np.asarray(v, float) for v in betas])
    u, s, _ = np.linalg.svd(b - b.mean(axis=1, keepdims=True), full_matrices=False)
    keep = s > 1e-8 * max(s.max(initial=0.0), 1e-12)
    return u[:, keep] if keep.any() else None


def contrast_recovery(estimated, truth) -> float:
    """Mean cosine of the principal angles between two contrast spans (|cos| for two clusters)."""
    a, b = contrast_span(estimated), contrast_span(truth)
    if a is None or b is None:
        return random_floor(len(truth[0]))
    angles = np.linalg.svd(a.T @ b, compute_uv=False)
    return float(np.clip(angles[: min(a.shape[1], b.shape[1])], 0.0, 1.0).mean())


def bic(loglik: Column | float, n: Column | float, k: int, q: int, p: int):
    """-2 l + df log n with df = (K-1) + 2 K q + K p."""
    df = (k - 1) + 2 * k * q + k * p
    return -2.0 * loglik + df * (F.log(n) if isinstance(n, Column) else math.log(n))

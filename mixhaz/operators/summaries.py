"""Summaries of long result tables: one row per (cell, replicate, method)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mixhaz.operators.metrics import random_floor
from mixhaz.operators.lookup import asof
from mixhaz.operators.prefix import average_ranks, cut, running_totals


def mcse(x: Column | str) -> Column:
    """Monte Carlo standard error of a mean."""
    c = F.col(x) if isinstance(x, str) else x
    return F.stddev_samp(c) / F.sqrt(F.count(c))


def score_degenerate(rows: DataFrame, mode: str = "exclude") -> DataFrame:
    """Treat degenerate fits: leave them out, score them at chance level, or keep them."""
    bad = F.coalesce(F.col("degenerate"), F.lit(False))
    if mode == "as_scored":
        return rows
    if mode == "exclude":
        return rows.where(~bad)
    if mode != "floor":
        raise ValueError(f"unknown mode: {mode}")
    return rows.withColumn("recovery", F.when(bad, random_floor(F.col("p"))).otherwise(F.col("recovery")))


def cell_means(rows: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Counts, means and Monte Carlo errors per group, without failed or degenerate fits."""
    kept = score_degenerate(rows).where(~F.col("failed"))
    picks = [F.count("*").alias("reps")]
    for m in measures:
        picks += [F.avg(m).alias(m), mcse(m).alias(f"{m}_mcse")]
    return kept.groupBy(*by).agg(*picks)


def share_of_reference(means: DataFrame, by: Sequence[str], reference: str) -> DataFrame:
    """Recovery above chance as a percentage of the reference method's, within each group."""
    group = W.partitionBy(*by)
    ref = F.max(F.when(F.col("method") == reference, F.col("recovery"))).over(group)
    floor = random_floor(F.col("p"))
    return means.withColumn("reference", ref).withColumn(
        "pct", 100 * (F.col("recovery") - floor) / (F.col("reference") - floor)).withColumn(
        "pct_mcse", 100 * F.col("recovery_mcse") / (F.col("reference") - floor))


def wide(rows: DataFrame, by: Sequence[str], methods: Mapping[str, str], value: str = "recovery",
         mode: str = "exclude") -> DataFrame:
    """One row per (by, rep) with one column per method (`methods`: column name -> method)."""
    kept = score_degenerate(rows, mode).where(~F.col("failed"))
    piv = kept.groupBy(*by, "rep").pivot("method", list(methods.values())).agg(F.max(value))
    return piv.select(*by, "rep", *[F.col(f"`{m}`").alias(c) for c, m in methods.items()])


def paired_differences(table: DataFrame, by: Sequence[str], target: str, comparators: Sequence[str]) -> DataFrame:
    """Target minus comparator on the same replicate: pairs, mean, error, share of wins."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("comparator"), (F.col(target) - F.col(c)).alias("d"))
                                for c in comparators])).alias("x")
    long = table.select(*by, pairs).select(*by, "x.*")
    return long.groupBy(*by, "comparator").agg(
        F.count("d").alias("pairs"), mcse("d").alias("diff_mcse"),
        F.avg((F.col("d") > 0).cast("double")).alias("win"), F.avg("d").alias("diff"))


def normalised_gain(table: DataFrame, by: Sequence[str], target: str, base: str, ceiling: str) -> DataFrame:
    """(target - base) / (ceiling - base) as a ratio of paired means, with a delta-method error."""
    d = table.withColumn("a", F.col(target) - F.col(base)).withColumn("b", F.col(ceiling) - F.col(base))
    got = d.where("a is not null and b is not null").groupBy(*by).agg(
        F.count("*").alias("pairs"), F.var_samp("a").alias("va"), F.var_samp("b").alias("vb"),
        F.covar_samp("a", "b").alias("cab"), F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    g = F.col("ma") / F.col("mb")
    spread = F.greatest(F.col("va") - 2 * g * F.col("cab") + g * g * F.col("vb"), F.lit(0.0))
    return got.select(*by, "pairs", "ma", "mb", g.alias("norm_gain"),
                      (F.sqrt(spread / F.col("pairs")) / F.abs("mb")).alias("norm_mcse"))


def verdicts(diffs: DataFrame, by: Sequence[str]) -> DataFrame:
    """beats / loses / matches / mixed per group, from differences beyond two standard errors; null for a group without a usable one."""
    clear = F.abs("diff") > 2 * F.col("diff_mcse")
    better = F.bool_or(clear & (F.col("diff") > 0))
    worse = F.bool_or(clear & (F.col("diff") < 0))
    return diffs.groupBy(*by).agg(
        F.when(F.count(clear) == 0, F.lit(None)).when(better & worse, "mixed").when(better, "beats").when(worse, "loses")
        .otherwise("matches").alias("verdict"))


def decision_rule(diffs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Roll paired differences of several cells up: cells clearly worse, and whether the mean is clearly off zero."""
    worse = F.count_if(F.col("diff") < -2 * F.col("diff_mcse"))
    got = diffs.groupBy(*by).agg(F.count("*").alias("cells"), worse.alias("worse"), F.avg("diff").alias("mean_diff"),
                                 (2 * F.sqrt(F.sum(F.col("diff_mcse") ** 2)) / F.count("*")).alias("margin"))
    return got.withColumn("adopt", (F.col("worse") == 0) & (F.col("mean_diff") >= -F.col("margin")))


def rejection_rates(long: DataFrame, by: Sequence[str], pval: str = "pval", level: float = 0.05) -> DataFrame:
    """Share of p-values at or below the level, its error, and the upper acceptance limit."""
    valid = long.where(F.col(pval).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((F.col(pval) <= level).cast("double")).alias("rate"))
    r, n = F.col("rate"), F.col("n")
    limit = level + 2 * F.sqrt(F.lit(level * (1 - level)) / n)
    return valid.withColumn("rate_mcse", F.sqrt(r * (1 - r) / n)).withColumn("upper", limit).withColumn(
        "ok", F.col("rate") <= F.col("upper"))


def confusion(rows: DataFrame, by: Sequence[str], picked: str, values: Sequence[int]) -> DataFrame:
    """Share of replicates that picked each value."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[
        F.avg((F.col(picked) == v).cast("double")).alias(f"p_{v}") for v in values])


def best_row(rows: DataFrame, by: Sequence[str], score: str, tie: str) -> DataFrame:
    """The row with the highest score per group, the smallest `tie` on ties.

    A struct aggregate, not a window: rows combine before the shuffle, so a large
    group never sorts in one task.
    """
    rest = [c for c in rows.columns if c not in by]
    picked = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(tie))).alias("b"))
    return picked.select(*by, "b.*")


def exact_mean(x: Column, digits: int = 9) -> Column:
    """Average of values rounded to `digits`, summed as decimals: the same whatever the order of rows, so it may be compared with an edge."""
    return F.sum(x.cast(f"decimal(18,{digits})")).cast("double") / F.count(x)


def histogram(df: DataFrame, x: str, bins: int = 20, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Counts in equal bins, right-closed, the first including its lower end. Bin b ends at low + b * (high - low) / bins, as a double."""
    def edge(b):
        return F.lit(low) + b * F.lit(high - low) / F.lit(bins)

    near = F.greatest(F.ceil((F.col(x) - low) * F.lit(bins) / F.lit(high - low)), F.lit(1)).cast("int")
    bin_ = F.when((near > 1) & (F.col(x) <= edge(near - 1)), near - 1).when(F.col(x) > edge(near), near + 1).otherwise(near)
    return df.where(F.col(x).between(low, high)).groupBy(F.least(bin_, F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def ks_uniform(df: DataFrame, x: str) -> DataFrame:
    """Kolmogorov-Smirnov distance from U(0,1) and its asymptotic p-value."""
    counts = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("_n")).persist()
    n = counts.agg(F.sum("_n").cast("double").alias("t")).scalar()
    cum = running_totals(cut(counts, x), [x], {"_cum": "_n"}).withColumn("_total", n)
    gap = F.greatest(F.col("_cum") / F.col("_total") - F.col(x),
                     F.col(x) - (F.col("_cum") - F.col("_n")) / F.col("_total"))
    out = cum.agg(F.max(gap).alias("d"), F.max("_total").alias("n"))
    lam2 = F.col("n") * F.col("d") * F.col("d")
    # two forms of one limit: each converges within a few terms on its side
    far = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * lam2) for k in range(1, 9)), F.lit(0.0))
    near = 1 - F.sqrt(F.lit(2 * math.pi) / lam2) * sum((F.exp(F.lit(-((2 * k - 1) * math.pi) ** 2 / 8) / lam2) for k in range(1, 9)), F.lit(0.0))
    tail = F.when(lam2 <= 0, 1.0).when(lam2 < 1.0, near).otherwise(far)
    return out.select("d", F.col("n").cast("long").alias("n"), F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)).alias("p_value"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with averaged ties. Rows find their ranks through the index of an as-of lookup, so a common value is no hot key."""
    rows = df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()).persist()
    ranked = rows
    for name, rank in ((x, "_rx"), (y, "_ry")):
        ranked = asof(ranked, average_ranks(rows, name, rank), name, [rank])
    return ranked.agg(F.corr("_rx", "_ry").alias("rho"))


def least_squares(df: DataFrame, y: Column, xs: Mapping[str, Column], weight: Column | None = None) -> dict:
    """Weighted least squares with intercept: estimates, errors, 95% intervals.

    One aggregate collects the p x p normal equations; only that leaves Spark.
    """
    w = F.lit(1.0) if weight is None else weight
    names = ["(Intercept)", *xs]
    cols = [F.lit(1.0), *xs.values()]
    p = len(cols)
    picks = [F.sum(w * cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)]
    picks += [F.sum(w * cols[i] * y).alias(f"b{i}") for i in range(p)]
    picks += [F.sum(w * y * y).alias("yy"), F.count("*").alias("n")]
    row = df.agg(*picks).first()
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)
    b = np.array([row[f"b{i}"] for i in range(p)], float)
    est = np.linalg.solve(a, b)
    dof = row["n"] - p
    s2 = max(row["yy"] - est @ b, 0.0) / dof
    se = np.sqrt(s2 * np.diag(np.linalg.inv(a)))
    t = t_quantile(0.975, dof)
    return {"term": names, "estimate": est.tolist(), "se": se.tolist(), "low": (est - t * se).tolist(),
            "high": (est + t * se).tolist(), "n": row["n"], "sigma": math.sqrt(s2)}


def t_quantile(prob: float, dof: float) -> float:
    """Student t quantile by bisection on a numerically integrated density."""
    half = np.linspace(0.0, 1.0, 20001)
    const = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)

    def below(x):
        g = half * x
        f = const * (1 + g * g / dof) ** (-(dof + 1) / 2)
        return 0.5 + x * float(np.sum((f[1:] + f[:-1]) / 2) / 20000)

    lo, hi = 0.0, 1e3
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < prob else (lo, mid)
    return (lo + hi) / 2


def dataset_hash(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Order-free fingerprint: sum of the leading 32 bits of each row's md5, modulo 2**63 - 1."""
    row = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).cast("binary"))
    return df.groupBy(*keys).agg(
        (F.sum(F.conv(F.substring(row, 1, 8), 16, 10).cast("decimal(28,0)")) % F.lit(2 ** 63 - 1)).cast("long").alias("fingerprint"),
        F.count("*").alias("n"))


def compare_manifests(left: DataFrame, right: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Full outer comparison of two manifests: same, different, or present on one side only."""
    l = left.select(*on, F.col(value).alias("left_value"))
    r = right.select(*on, F.col(value).alias("right_value"))
    state = (F.when(F.col("left_value").isNull(), "right_only").when(F.col("right_value").isNull(), "left_only")
             .when(F.col("left_value") == F.col("right_value"), "same").otherwise("different"))
    return l.join(r, list(on), "full_outer").withColumn("state", state)

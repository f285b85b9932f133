"""Folds, permutations and bootstrap outcomes from hashed randomness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixhaz.functions.exprs import hash_uniform, total
from mixhaz.operators.prefix import hash_rank
from mixhaz.operators.survival import inverse_hazard_draw, inverse_survival_draw


def stratified_folds(df: DataFrame, nfolds: int, seed, ident: str = "id", status: str = "status",
                     keys: Sequence[str] = ()) -> DataFrame:
    """Balanced fold labels 1..nfolds, shuffled separately among events and censored rows."""
    ranked = hash_rank(df, seed, ident, [*keys, status], "_pos")
    return ranked.withColumn("fold", ((F.col("_pos") - 1) % nfolds + 1).cast("int")).drop("_pos")


def balanced_labels(df: DataFrame, k: int, seed, ident: str = "id", out: str = "label", source: DataFrame | None = None) -> DataFrame:
    """Random labels 0..k-1 whose counts differ by at most one.

    A table that gets several columns of labels passes itself without any as `source`, or each column doubles the work.
    """
    ranked = hash_rank(df, seed, ident, (), "_pos", source=source)
    return ranked.withColumn(out, ((F.col("_pos") - 1) % k).cast("int")).drop("_pos")


def permute_outcome(df: DataFrame, seed, ident: str = "id", keys: Sequence[str] = ()) -> DataFrame:
    """Every row keeps its features and takes the (time, status) of a randomly matched row."""
    hashed = [*keys, ident]
    takes = hash_rank(df.drop("time", "status"), f"{seed}t", ident, keys, "_pos", hashed)
    gives = hash_rank(df.select(*keys, ident, "time", "status"), f"{seed}g", ident, keys, "_pos", hashed).drop(ident)
    return takes.join(gives, [*keys, "_pos"]).drop("_pos")


def drawn_cluster(u: Column, memberships: Sequence[Column], values: Sequence[Column]) -> tuple[Column, Column]:
    """(cluster, its value): the first cluster, from 1, whose cumulative membership reaches the uniform `u`; the last one beyond rounding."""
    z, value = F.lit(len(memberships)), values[-1]
    for k in range(len(memberships) - 2, -1, -1):
        reach = u <= total(memberships[: k + 1])
        z, value = F.when(reach, k + 1).otherwise(z), F.when(reach, values[k]).otherwise(value)
    return z.cast("int"), value


def bootstrap_outcome(
    df: DataFrame, seed, eta: Column, baseline: DataFrame, censoring: DataFrame, last_time: Column | float,
    ident: str = "id", keys=(), tag=(),
) -> DataFrame:
    """Outcomes drawn from a fitted model: event time by inverse hazard, censoring from its curve.

    `baseline` (keys, time, cumhaz) and `censoring` (time, surv) are step functions;
    follow-up ends at `last_time`. `tag` names columns that separate replicates.
    """
    tmax = F.lit(last_time) if not isinstance(last_time, Column) else last_time
    base = df.drop("time", "status")
    drawn = base.withColumn("_h", -F.log(hash_uniform(f"{seed}e", *tag, ident)) / F.exp(eta)).withColumn(
        "_u", hash_uniform(f"{seed}c", *tag, ident))
    drawn = inverse_hazard_draw(drawn, "_h", baseline, "_event", keys)
    drawn = inverse_survival_draw(drawn, "_u", censoring, "_cens")
    never = F.lit(float("inf"))
    t, c = F.coalesce("_event", never), F.coalesce("_cens", never)
    out = drawn.withColumn("time", F.least(t, c, tmax)).withColumn(
        "status", ((t <= c) & (t <= tmax)).cast("int"))
    return out.drop("_h", "_u", "_event", "_cens")

"""Verdicts and consistency checks of result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixhaz.operators.metrics import random_floor


def cell_verdict(diff: str = "diff", error: str = "diff_mcse") -> Column:
    """beats / loses / matches by two standard errors; null where either number is missing or not finite."""
    d, e = F.col(diff), F.col(error)
    usable = d.isNotNull() & e.isNotNull() & ~F.isnan(d) & ~F.isnan(e) & (F.abs(d) < float("inf")) & (F.abs(e) < float("inf"))
    return F.when(usable, F.when(d > 2 * e, "beats").when(d < -2 * e, "loses").otherwise("matches"))


def regime_verdicts(cells: DataFrame, regime: Column, verdict: str = "verdict") -> DataFrame:
    """One verdict per regime from those of its cells; cells without one do not count."""
    better, worse = F.bool_or(F.col(verdict) == "beats"), F.bool_or(F.col(verdict) == "loses")
    got = cells.groupBy(regime.alias("regime")).agg(F.count(verdict).alias("cells"), F.when(F.count(verdict) == 0, F.lit(None)).when(
        better & worse, "mixed").when(better, "beats").when(worse, "loses").otherwise("matches").alias("verdict"))
    return got


def spread_values(rows: DataFrame, by: Sequence[str], names: str, picked: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Several value columns spread over the values of `names`: columns value_name."""
    return rows.groupBy(*by).agg(*[F.max(F.when(F.col(names) == n, F.col(v))).alias(f"{v}_{n}") for v in values for n in picked])


def checked_against(rows: DataFrame, manifest: DataFrame, on: Sequence[str], same: Mapping[str, str], excused: str) -> DataFrame:
    """(on, checked rows, bad): groups with a row that the manifest lacks or contradicts, unless the row is excused from the comparison.

    `same` pairs a column of the rows with the manifest's; a row whose group is missing from the manifest is bad in any case.
    """
    held = manifest.select(*on, *[F.col(v).alias(f"_{v}") for v in same.values()], F.lit(True).alias("_there"))
    agree = F.lit(True)
    for mine, theirs in same.items():
        agree = agree & F.coalesce(F.col(mine) == F.col(f"_{theirs}"), F.lit(False))
    good = F.col("_there").isNotNull() & (F.coalesce(F.col(excused), F.lit(False)) | agree)
    return (rows.join(held, list(on), "left").groupBy(*on).agg(F.count("*").alias("checked"), F.bool_or(F.col("_there").isNull()).alias("missing"),
                                                             F.bool_or(~good).alias("bad")))


def one_dataset_each(rows: DataFrame, on: Sequence[str], digest: str, excused: str) -> DataFrame:
    """(on, datasets, consistent): how many different data sets the usable rows of a group saw; at most one is consistent."""
    seen = rows.groupBy(*on).agg(F.count_distinct(F.when(~F.coalesce(F.col(excused), F.lit(False)), F.col(digest))).alias("datasets"))
    return seen.withColumn("consistent", F.col("datasets") <= 1)


def rejections_of_two(frozen: DataFrame, new: DataFrame, on: Sequence[str], by: Sequence[str], p: str, excused: str, level: float = 0.05) -> DataFrame:
    """Both tables' rejection rates over the data sets that both hold and neither excuses, and the share with the same decision."""
    old = frozen.where(~F.col(excused)).select(*on, F.col(p).alias("_old"))
    both = new.where(~F.col(excused)).join(old, list(on))
    a, b = F.col("_old") <= level, F.col(p) <= level
    share = lambda c: F.avg(c.cast("double"))
    return both.groupBy(*by).agg(F.count("*").alias("datasets"), share(a).alias("rejects_frozen"), share(b).alias("rejects_new"),
                                 share(a == b).alias("agree"))


def pilot_verdicts(means: DataFrame, blind: Sequence[str], informed: str, uninformed: str, p: Column) -> DataFrame:
    """Three checks of a pilot from means per (beta_sep, method), as one row of measures and verdicts.

    P1: blind methods stay within 0.05 of chance and the informed one does not, over separations of 1 and more. P2: the gain over the uninformed
    method, per squared separation, varies by less than half. P3: labels are at chance (index below 0.10) while the contrast is recovered.
    """
    floor = random_floor(p)
    wide = means.where("beta_sep >= 1")
    per_method = wide.groupBy("method").agg((F.avg("recovery") - F.first(floor)).alias("above"))
    one = per_method.agg(F.max(F.when(F.col("method").isin(*blind), F.col("above"))).alias("blind_excess"),
                         F.max(F.when(F.col("method") == informed, F.col("above"))).alias("informed_excess"))
    gain = (wide.groupBy("beta_sep").agg((F.max(F.when(F.col("method") == informed, F.col("recovery")))
                                          - F.max(F.when(F.col("method") == uninformed, F.col("recovery")))).alias("gain")))
    two = gain.agg((F.stddev_samp(F.col("gain") / F.col("beta_sep") ** 2) / F.avg(F.col("gain") / F.col("beta_sep") ** 2)).alias("variation"))
    three = means.where(F.col("method") == informed).agg(F.max("ari").alias("best_ari"), F.max(F.col("recovery") - floor).alias("best_excess"))
    row = one.withColumn("variation", two.scalar()).withColumn("s", three.select(F.struct("best_ari", "best_excess")).scalar()).select(
        "blind_excess", "informed_excess", "variation", "s.*")
    return row.select("*", ((F.col("blind_excess") < 0.05) & (F.col("informed_excess") > 0.05)).alias("p1"),
                      (F.col("variation").isNotNull() & (F.col("variation") < 0.5)).alias("p2"),
                      ((F.col("best_ari") < 0.10) & (F.col("best_excess") > 0.05)).alias("p3"))


def judged_claims(facts: DataFrame, rules: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(id, by, cells, met, holds): claims judged on facts.

    facts: measure, value (a row for each cell, and for each group of `by`). rules: id, measure, relation (one of > >= < <=; null: told, not judged)
    and bound; the rules of one id all have to hold. holds is three-valued: false if one condition fails, else null if one is unknown or there is
    none, else true.
    """
    groups = facts.select(*by).distinct() if by else None
    every = rules.join(groups, how="cross") if by else rules  # a few rules for a few groups, so that a claim without facts shows
    v, b = F.col("value"), F.col("bound")
    told = F.when(F.isnan(v), F.lit(None)).otherwise(
        F.when(F.col("relation") == ">", v > b).when(F.col("relation") == ">=", v >= b).when(F.col("relation") == "<", v < b).when(F.col("relation") == "<=", v <= b))
    rows = every.join(facts, [*by, "measure"], "left").withColumn("met", told)
    good, bad = F.count_if("met"), F.count_if(~F.col("met"))
    return rows.groupBy("id", *by).agg(F.count("value").alias("cells"), good.alias("met"),
                                       F.when(bad > 0, False).when(good < F.count("*"), F.lit(None)).otherwise(True).alias("holds"))

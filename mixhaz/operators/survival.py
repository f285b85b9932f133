"""Survival building blocks on (time, status) tables: risk sets, baselines, curves, concordance.

Everything is aggregated to distinct times before it is ordered, and ordered with
piecewise running sums, so neither many rows nor one very common time overloads a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixhaz.functions.exprs import clamp
from mixhaz.operators.lookup import asof
from mixhaz.operators.prefix import PIECE, cut, running_totals
from mixhaz.operators.ranking import dominance

MAX_JUMP = 10.0
MAX_CUMHAZ = 500.0
DENOM_FLOOR = 1e-8
ETA_CLAMP = 30.0
TINY_HAZARD = 1e-12


def _expr(x: Column | str) -> Column:
    if isinstance(x, (int, float)):
        return F.lit(float(x))
    return F.col(x) if isinstance(x, str) else x


def clean_weight(w: Column) -> Column:
    """Missing, non-finite or negative weights count as zero."""
    ok = w.isNotNull() & ~F.isnan(w) & (w >= 0) & (w < F.lit(float("inf")))
    return F.when(ok, w).otherwise(F.lit(0.0))


def time_table(
    df: DataFrame, event_weight: Column | str = "status", risk_weight: Column | str | float = 1.0,
    keys: Sequence[str] = (), time: str = "time", status: str = "status",
) -> DataFrame:
    """One row per distinct time: event weight, risk weight in the risk set, event count.

    `at_risk` sums the risk weight over all rows with this time or a later one.
    """
    d = F.col(status)
    by_time = df.groupBy(*keys, F.col(time).alias("time")).agg(
        F.sum(F.when(d == 1, _expr(event_weight)).otherwise(F.lit(0.0))).cast("double").alias("num"),
        F.sum(_expr(risk_weight)).cast("double").alias("weight"),
        F.sum(d).cast("long").alias("events"),
        F.count("*").alias("rows"),
    ).persist()
    return running_totals(cut(by_time, "time"), ["time"], {"at_risk": "weight"}, keys, descending=True)


def hazard_steps(
    table: DataFrame, keys: Sequence[str] = (), max_jump: float = MAX_JUMP,
    max_cumhaz: float = MAX_CUMHAZ, denom_floor: float = DENOM_FLOOR,
) -> DataFrame:
    """Capped hazard jumps and their capped cumulative sum at every distinct time.

    The jump is capped first; the cumulative hazard is the sum of capped jumps, and
    its own cap does not change the jumps.
    """
    raw = F.col("num") / F.greatest(F.col("at_risk"), F.lit(float(denom_floor)))
    steps = table.withColumn("raw_jump", raw).withColumn("jump", F.least("raw_jump", F.lit(float(max_jump))))
    summed = running_totals(steps, ["time"], {"raw_cumhaz": "jump"}, keys)
    return summed.withColumn("cumhaz", F.least("raw_cumhaz", F.lit(float(max_cumhaz)))).drop(PIECE)


def guard_counts(steps: DataFrame, max_jump: float = MAX_JUMP, max_cumhaz: float = MAX_CUMHAZ,
                 denom_floor: float = DENOM_FLOOR) -> DataFrame:
    """How often each bound on the baseline was hit, over the event times."""
    return steps.where("events > 0").agg(
        F.count_if(F.col("raw_jump") > max_jump).alias("max_jump"),
        F.count_if(F.col("raw_cumhaz") > max_cumhaz).alias("max_cumhaz"),
        F.count_if((F.col("at_risk") < denom_floor) & (F.col("num") > 0)).alias("denom_floor"),
        F.count("*").alias("checked"),
    )


def breslow(
    df: DataFrame, eta: Column | str | None = None, weight: Column | str | None = None,
    keys: Sequence[str] = (), **caps,
) -> DataFrame:
    """Weighted Breslow baseline at the event times; empty if the events carry no weight."""
    w = clean_weight(_expr(weight)) if weight is not None else F.lit(1.0)
    e = clamp(_expr(eta), ETA_CLAMP) if eta is not None else F.lit(0.0)
    steps = hazard_steps(time_table(df, w, w * F.exp(e), keys), keys, **caps)
    events = steps.where("events > 0")
    if weight is None:
        return events.select(*keys, "time", "num", "at_risk", "jump", "cumhaz")
    mass = df.groupBy(*keys).agg(F.sum(w * F.col("status")).alias("_mass"))
    if keys:
        events = events.join(mass.where("_mass >= 1e-10"), list(keys), "left_semi")
    else:
        events = events.where(mass.select("_mass").scalar() >= 1e-10)
    return events.select(*keys, "time", "num", "at_risk", "jump", "cumhaz")


def shared_breslow(df: DataFrame, etas: Sequence[Column], tau: Sequence[Column], keys: Sequence[str] = (),
                   **caps) -> DataFrame:
    """One baseline for all clusters: plain event counts over tau-weighted risk sets."""
    risk = sum((t * F.exp(clamp(e, ETA_CLAMP)) for t, e in zip(tau, etas)), F.lit(0.0))
    steps = hazard_steps(time_table(df, F.lit(1.0), risk, keys), keys, **caps)
    return steps.where("events > 0").select(*keys, "time", "num", "at_risk", "jump", "cumhaz")


def empty_baseline(spark) -> DataFrame:
    return spark.createDataFrame([], "time double, jump double, cumhaz double")


def cumhaz_at(queries: DataFrame, baseline: DataFrame, on: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative hazard at each query time: the last step at or before it, 0 before the first."""
    got = asof(queries, baseline.select(*keys, F.col("time").alias("_t"), "cumhaz"), on, ["cumhaz"], "_t", keys)
    return got.withColumn("cumhaz", F.coalesce("cumhaz", F.lit(0.0)))


def jump_at(queries: DataFrame, baseline: DataFrame, on: str = "time") -> DataFrame:
    """Hazard jump at the last step at or before each query time; before the first, the first jump."""
    got = asof(queries, baseline.select(F.col("time").alias("_t"), "jump"), on, ["jump"], "_t")
    first = baseline.agg(F.min_by("jump", "time").alias("j")).scalar()
    return got.withColumn("jump", F.coalesce("jump", first))


def attach_steps(df: DataFrame, steps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Give every row the cumulative hazard and jump of its own time.

    `steps` holds every distinct time of `df` (see `hazard_steps`), so this is an
    equality join: Spark broadcasts a small step table and splits skewed times otherwise.
    """
    return df.join(steps.select(*keys, "time", "cumhaz", "jump"), [*keys, "time"])


def log_density(status: Column, eta: Column, cumhaz: Column, jump: Column) -> Column:
    """d (log jump + eta) - cumhaz exp(eta), the jump floored for events."""
    haz = F.when(status == 1, F.greatest(jump, F.lit(TINY_HAZARD))).otherwise(F.lit(1.0))
    return status * (F.log(haz) + eta) - cumhaz * F.exp(eta)


def partial_loglik(df: DataFrame, eta: Column | str, keys: Sequence[str] = ()) -> DataFrame:
    """Cox log partial likelihood with Breslow ties, shifted by the largest eta for stability."""
    e = _expr(eta)
    top = df.agg(F.max(e).alias("m")).scalar()
    shifted = df.withColumn("_eta", e).withColumn("_rel", F.exp(F.col("_eta") - top))
    table = time_table(shifted, F.col("_eta"), F.col("_rel"), keys)
    # num sums eta over the events of a time; events times log risk is the other half
    term = F.col("num") - F.col("events") * (top + F.log("at_risk"))
    return table.where("events > 0").groupBy(*keys).agg(F.sum(term).alias("partial_loglik"))


def kaplan_meier(df: DataFrame, event: Column | str = "status", keys: Sequence[str] = ()) -> DataFrame:
    """Product-limit curve of `event` (use 1 - status for the censoring distribution)."""
    flagged = df.withColumn("_d", _expr(event).cast("int"))
    table = time_table(flagged, F.lit(1.0), F.lit(1.0), keys, status="_d")
    alive = F.col("at_risk") > F.col("num")
    logs = F.when(alive, F.log1p(-F.col("num") / F.col("at_risk"))).otherwise(F.lit(0.0))
    dead = F.when(alive, F.lit(0)).otherwise(F.lit(1))
    summed = running_totals(table, ["time"], {"_log": logs, "_dead": dead}, keys)
    surv = F.when(F.col("_dead") > 0, F.lit(0.0)).otherwise(F.exp("_log"))
    return summed.select(*keys, "time", F.col("at_risk").alias("n_risk"), F.col("num").alias("n_event"),
                         surv.alias("surv"))


def inverse_hazard_draw(df: DataFrame, need: str, baseline: DataFrame, out: str = "draw",
                        keys: Sequence[str] = ()) -> DataFrame:
    """First step whose cumulative hazard reaches `need`; null (never) beyond the last step."""
    return _first_reach(df, need, baseline, "cumhaz", out, keys)


def inverse_survival_draw(df: DataFrame, u: str, curve: DataFrame, out: str = "draw",
                          keys: Sequence[str] = ()) -> DataFrame:
    """First time at which the survival curve has dropped to `u` or below."""
    flipped = curve.withColumn("_fall", -F.col("surv"))
    asked = df.withColumn("_need", -F.col(u))
    return _first_reach(asked, "_need", flipped, "_fall", out, keys).drop("_need")


def _first_reach(df, need, curve, level, out, keys):
    # equal levels keep their earliest time
    steps = curve.groupBy(*keys, level).agg(F.min("time").alias(out))
    return asof(df, steps, need, [out], level, keys, direction="forward")


def concordance(df: DataFrame, score: Column | str, time: str = "time", status: str = "status") -> DataFrame:
    """Share of comparable pairs in which the earlier event has the higher score (ties count half).

    A pair is comparable when the earlier row is an event, or when both times are
    equal and exactly one is an event (the other outlives it). Pairs are counted as
    inversions of two orders (see `ranking`); none is materialised.
    """
    cells = df.select(F.col(time).cast("double").alias("time"), F.col(status).cast("int").alias("d"),
                      _expr(score).cast("double").alias("score"))
    cells = cells.groupBy("time", (1 - F.col("d")).alias("out"), "score").agg(
        F.count("*").cast("double").alias("n"), F.sum("d").cast("double").alias("e")).persist()
    by_time = cells.groupBy("time").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).persist()
    later = running_totals(cut(by_time, "time"), ["time"], {"from_here": "n"}, descending=True)
    comparable = later.agg(F.sum(F.col("e") * (F.col("from_here") - F.col("e")))).first()[0]
    concordant, tied = dominance(cells)
    cells.unpersist()
    by_time.unpersist()
    return df.sparkSession.createDataFrame([(comparable, concordant, tied)], "comparable double, concordant double, tied double").select(
        "*", F.try_divide(F.col("concordant") + F.col("tied") / 2, "comparable").alias("concordance"))

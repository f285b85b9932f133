"""Registered queries over the given tables, each with the SQL that must give the same rows.

All queries start from `spell` (one row per order, see `sources.spells`) or from
`trial` (one row per order and method, averaged from line items) and read whole tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixhaz.functions import exprs as X
from mixhaz.operators import checks, metrics, mixture, resample, scaling, summaries, survival
from mixhaz.operators.prefix import grouped_quantiles
from mixhaz.sources.spells import FEATURES, INDICATOR, spells, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# ---------------------------------------------------------------- shared inputs

# Example parameters of a two-cluster model, used by every step-by-step query.
BETA = {"z_price": (0.30, -0.40), "z_bal": (-0.20, 0.15), "z_qty": (0.10, 0.05), "z_ind": (0.25, -0.10)}
PI = (0.6, 0.4)
CLUSTER_FEATURES = ["z_price", "z_lines", "z_disc"]
MU = ((-0.3, 0.2, 0.1), (0.4, -0.3, -0.2))
VAR = ((0.8, 1.1, 0.9), (1.2, 0.7, 1.0))
RIDGE = 1e-6
PREDICT_TIMES = (30.0, 180.0, 700.0)

SPELL = """nx AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate,
    lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx FROM orders),
li AS (SELECT l_orderkey, count(*) AS n, avg(l_discount) AS d, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
spell AS (SELECT o_orderkey AS id,
    greatest(date_diff('day', o_orderdate, coalesce(nx, TIMESTAMP '2001-08-02'))::DOUBLE, 0.1) AS time,
    (nx IS NOT NULL)::INTEGER AS status, o_totalprice AS f_price, c_acctbal AS f_bal,
    coalesce(n, 0)::DOUBLE AS f_lines, coalesce(d, 0.0) AS f_disc, coalesce(q, 0.0) AS f_qty,
    (c_mktsegment = 'BUILDING')::INTEGER AS i_building
  FROM nx JOIN customer ON o_custkey = c_custkey LEFT JOIN li ON l_orderkey = o_orderkey)"""

_SRC = {"z_price": "f_price", "z_bal": "f_bal", "z_lines": "f_lines", "z_disc": "f_disc", "z_qty": "f_qty",
        "z_ind": "i_building"}
SCALED = SPELL + ",\nsc AS (SELECT " + ", ".join(
    f"avg({s}) AS m_{s}, stddev_samp({s}) AS s_{s}" for s in _SRC.values()) + " FROM spell),\nz AS (SELECT id, time, status, " + ", ".join(
    f"({s} - m_{s}) / s_{s} AS {z}" for z, s in _SRC.items()) + " FROM spell, sc)"


def _lin(k: int) -> str:
    return " + ".join(f"({b[k]}) * {z}" for z, b in BETA.items())


PARS = SCALED + f",\npars AS (SELECT *, {_lin(0)} AS eta1, {_lin(1)} AS eta2 FROM z)"

# shared baseline: event counts over risk sets weighted by the prior class shares
HAZ = PARS + f""",
bt AS (SELECT time, sum(status) AS num, sum({PI[0]} * exp(eta1) + {PI[1]} * exp(eta2)) AS w FROM pars GROUP BY time),
rs AS (SELECT time, num, sum(w) OVER (ORDER BY time DESC) AS den FROM bt),
st AS (SELECT time, num, den, least(num / greatest(den, 1e-8), 10.0) AS jump FROM rs),
haz AS (SELECT *, least(sum(jump) OVER (ORDER BY time), 500.0) AS cumhaz FROM st)"""


def _gauss(k: int) -> str:
    parts = [f"({z} - ({m})) * ({z} - ({m})) / {v + RIDGE} + ln({v + RIDGE})"
             for z, m, v in zip(CLUSTER_FEATURES, MU[k], VAR[k])]
    return f"ln({PI[k]}) - 0.5 * ({len(parts)} * ln(2 * pi()) + {' + '.join(parts)})"


def _surv(k: int) -> str:
    return (f"status * (CASE WHEN status = 1 THEN ln(greatest(jump, 1e-12)) ELSE 0 END + eta{k + 1})"
            f" - cumhaz * exp(eta{k + 1})")


EVID = HAZ + f""",
ev AS (SELECT p.*, h.jump, h.cumhaz, {_gauss(0)} AS g1, {_gauss(1)} AS g2, {_surv(0)} AS s1, {_surv(1)} AS s2
  FROM pars p JOIN haz h USING (time))"""

TAU = EVID + """,
tau AS (SELECT *, g1 + s1 AS l1, g2 + s2 AS l2, 1 / (1 + exp(g2 + s2 - g1 - s1)) AS tau1,
    1 / (1 + exp(g1 + s1 - g2 - s2)) AS tau2 FROM ev)"""

TRIAL = """trial AS (SELECT o_orderpriority AS cell, l_orderkey AS rep,
    CASE l_linenumber WHEN 1 THEN 'single' WHEN 2 THEN 'two_stage' WHEN 3 THEN 'features_only'
      WHEN 4 THEN 'joint' WHEN 5 THEN 'oracle' WHEN 6 THEN 'gated' ELSE 'tight' END AS method,
    10 AS p, avg(1 / (1 + l_extendedprice / 50000.0)) AS recovery, sum((l_discount * 10)::DECIMAL(18, 9))::DOUBLE / count(*) AS ari,
    sum((l_tax * 10)::DECIMAL(18, 9))::DOUBLE / count(*) AS mse_eta, sum(l_quantity) AS events, avg(l_extendedprice / 1000.0) AS secs,
    bool_or(l_returnflag = 'R' AND l_tax > 0.07) AS failed,
    bool_or(l_linestatus = 'O' AND l_discount > 0.085) AS degenerate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"""
METHODS = {m: m for m in ("single", "two_stage", "features_only", "joint", "oracle", "gated", "tight")}
WIDE = TRIAL + ",\nwide AS (SELECT cell, rep, " + ", ".join(
    f"max(recovery) FILTER (method = '{m}') AS {m}" for m in METHODS) + \
    " FROM trial WHERE NOT failed AND NOT degenerate GROUP BY 1, 2)"


def spell(spark, sf) -> DataFrame:
    return spells(spark, sf).persist()


def scaled(spark, sf) -> DataFrame:
    """Standardised spells; the one-row scaler is read first."""
    s = spell(spark, sf)
    z = scaling.fit_scaler(s, list(_SRC.values())).apply()
    return s.select("id", "time", "status", *[c.alias(n) for n, c in zip(_SRC, z)])


def pars(spark, sf) -> DataFrame:
    cols = [F.col(z) for z in BETA]
    return scaled(spark, sf).select("*", *[X.dot(cols, [b[k] for b in BETA.values()]).alias(f"eta{k + 1}")
                                           for k in range(2)])


def steps_of(df: DataFrame) -> DataFrame:
    risk = PI[0] * F.exp("eta1") + PI[1] * F.exp("eta2")
    return survival.hazard_steps(survival.time_table(df, F.lit(1.0), risk))


def evidence(spark, sf) -> DataFrame:
    """Rows with feature evidence g, survival evidence s and their parts."""
    p = pars(spark, sf)
    rows = survival.attach_steps(p, steps_of(p))
    g = mixture.feature_evidence([F.col(z) for z in CLUSTER_FEATURES], PI, MU, [_diag(v) for v in VAR], RIDGE)
    s = [survival.log_density(F.col("status"), F.col(f"eta{k}"), F.col("cumhaz"), F.col("jump")) for k in (1, 2)]
    return rows.select("*", g[0].alias("g1"), g[1].alias("g2"), s[0].alias("s1"), s[1].alias("s2"))


def _diag(v):
    return [[x if i == j else 0.0 for j in range(len(v))] for i, x in enumerate(v)]


def memberships(spark, sf, gamma: float = 1.0, temp: float = 1.0) -> DataFrame:
    ev = evidence(spark, sf)
    l = mixture.sanitise([F.col("g1") + gamma * F.col("s1"), F.col("g2") + gamma * F.col("s2")])
    t = X.softmax(l, temp)
    return ev.select("*", l[0].alias("l1"), l[1].alias("l2"), t[0].alias("tau1"), t[1].alias("tau2"))


#: line items that one task of `trial` joins and adds up; a task's memory goes by its rows, which bytes of a shuffle tell little about
LINE_ROWS = 200_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df`, dealt by its keys over as many tasks as `rows` rows ask for; few rows stay as they are."""
    tasks = -(-rows // LINE_ROWS)
    return df.repartition(tasks, *keys) if tasks > 1 else df


def trial(spark, sf) -> DataFrame:
    """Rows by (cell, rep, method). They stay dealt by rep, so steps that group by (cell, rep) need no further shuffle."""
    names = ["single", "two_stage", "features_only", "joint", "oracle", "gated"]
    method = F.lit("tight")
    for i, m in enumerate(names, 1):
        method = F.when(F.col("l_linenumber") == i, m).otherwise(method)
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_returnflag", "l_linestatus")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    n = lines.count()
    li = dealt(lines, n, "l_orderkey").join(dealt(orders, n, "l_orderkey"), "l_orderkey")
    return li.groupBy(F.col("o_orderpriority").alias("cell"), F.col("l_orderkey").alias("rep"),
                      method.alias("method")).agg(
        F.max(F.lit(10)).alias("p"), F.avg(1 / (1 + F.col("l_extendedprice") / 50000.0)).alias("recovery"),
        summaries.exact_mean(F.col("l_discount") * 10).alias("ari"), summaries.exact_mean(F.col("l_tax") * 10).alias("mse_eta"),
        F.sum("l_quantity").alias("events"), F.avg(F.col("l_extendedprice") / 1000.0).alias("secs"),
        F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.07)).alias("failed"),
        F.bool_or((F.col("l_linestatus") == "O") & (F.col("l_discount") > 0.085)).alias("degenerate"))


def r(c: Column | str, digits: int = 6, name: str | None = None) -> Column:
    cc = F.col(c) if isinstance(c, str) else c
    return F.round(cc, digits).alias(name or (c if isinstance(c, str) else None))


# ---------------------------------------------------------------- sources, validation, scaling

@query("spell", f"WITH {SPELL} SELECT id, time, status, f_price, f_bal, f_lines, round(f_disc, 6) AS f_disc, f_qty, i_building FROM spell")
def q_spell(spark, sf):
    return spells(spark, sf).withColumn("f_disc", F.round("f_disc", 6))


@query("role_split", """SELECT 'time' AS column_name, 'outcome' AS role UNION ALL SELECT 'status', 'outcome'
  UNION ALL SELECT 'i_building', 'indicator' UNION ALL SELECT unnest(['id', 'f_price', 'f_bal', 'f_lines', 'f_disc', 'f_qty']), 'feature'""")
def q_role_split(spark, sf):
    from mixhaz.sources.readers import assign_roles

    prepared = assign_roles(spell(spark, sf), "time", "status", INDICATOR)
    kind = {"time": "outcome", "status": "outcome", INDICATOR: "indicator"}
    # one output row per input column; the table itself is checked in full by assign_roles
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit(kind.get(c, "feature")).alias("role"))
             for c in [*prepared.features, *prepared.indicators, "time", "status"]]
    return prepared.data.agg(F.count("*").alias("_n")).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


@query("feature_nulls", f"WITH {SPELL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count_if({c} IS NULL)::BIGINT AS missing, count_if(isnan({c}::DOUBLE) OR isinf({c}::DOUBLE))::BIGINT AS nonfinite FROM spell"
    for c in [*FEATURES, INDICATOR]))
def q_feature_nulls(spark, sf):
    return scaling.column_faults(spells(spark, sf), [*FEATURES, INDICATOR])


@query("status_profile", f"""WITH {SPELL} SELECT count(*) AS n, sum(status)::BIGINT AS events, count_if(time < 0)::BIGINT AS negative,
  min(time) AS min_time, max(time) AS max_time, count(DISTINCT time) AS distinct_times FROM spell""")
def q_status_profile(spark, sf):
    return spells(spark, sf).agg(
        F.count("*").alias("n"), F.sum("status").alias("events"), F.count_if(F.col("time") < 0).alias("negative"),
        F.min("time").alias("min_time"), F.max("time").alias("max_time"), F.count_distinct("time").alias("distinct_times"))


@query("scaler_stats", f"WITH {SPELL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) AS center, round(stddev_samp({c}), 6) AS scale FROM spell"
    for c in [*FEATURES, INDICATOR]))
def q_scaler_stats(spark, sf):
    names = [*FEATURES, INDICATOR]
    one = scaling.scaler_stats(spells(spark, sf), names)
    cells = [F.struct(F.lit(n).alias("feature"), F.round(f"center_{i}", 6).alias("center"),
                      F.round(f"scale_{i}", 6).alias("scale")) for i, n in enumerate(names)]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


@query("scaled_features", f"WITH {SCALED} SELECT id, " + ", ".join(f"round({z}, 6) AS {z}" for z in _SRC) + " FROM z")
def q_scaled(spark, sf):
    return scaled(spark, sf).select("id", *[r(z) for z in _SRC])


@query("xs_standardize_skip01", f"WITH {SCALED} SELECT z.id, " + ", ".join(
    f"round(z.{z}, 6) AS {s}" for z, s in _SRC.items() if s != INDICATOR) + f", spell.{INDICATOR} FROM z JOIN spell USING (id)")
def q_xs(spark, sf):
    out = scaling.standardise_except_flags(spell(spark, sf), [*FEATURES, INDICATOR])
    return out.select("id", *[r(c) for c in FEATURES], INDICATOR)


@query("linear_predictors", f"WITH {PARS} SELECT id, round(least(greatest(eta1, -12), 12), 6) AS eta1, round(least(greatest(eta2, -12), 12), 6) AS eta2, (abs(eta1) > 12)::INTEGER + (abs(eta2) > 12)::INTEGER AS bound FROM pars")
def q_lp(spark, sf):
    p = pars(spark, sf)
    bound = (F.abs("eta1") > 12).cast("int") + (F.abs("eta2") > 12).cast("int")
    return p.select("id", F.round(X.clamp(F.col("eta1"), 12), 6).alias("eta1"),
                    F.round(X.clamp(F.col("eta2"), 12), 6).alias("eta2"), bound.alias("bound"))


# ---------------------------------------------------------------- survival primitives

@query("breslow_baseline", f"""WITH {PARS}, bt AS (SELECT time, sum(status) AS num, sum(exp(eta1)) AS w FROM pars GROUP BY time),
rs AS (SELECT time, num, sum(w) OVER (ORDER BY time DESC) AS den FROM bt),
st AS (SELECT time, num, den, num / den AS jump FROM rs WHERE num > 0)
SELECT time, num::DOUBLE AS num, round(den, 6) AS at_risk, round(jump, 9) AS jump, round(sum(jump) OVER (ORDER BY time), 6) AS cumhaz FROM st""")
def q_breslow(spark, sf):
    b = survival.breslow(pars(spark, sf), "eta1")
    return b.select("time", "num", r("at_risk"), r("jump", 9), r("cumhaz"))


@query("breslow_weighted", f"""WITH {PARS}, w AS (SELECT *, 1 / (1 + abs(z_bal)) AS wt FROM pars),
bt AS (SELECT time, sum(wt * status) AS num, sum(status) AS ev, sum(wt * exp(eta1)) AS w FROM w GROUP BY time),
rs AS (SELECT time, num, ev, sum(w) OVER (ORDER BY time DESC) AS den FROM bt),
st AS (SELECT time, num, den, num / den AS jump FROM rs WHERE ev > 0)
SELECT time, round(num, 6) AS num, round(den, 6) AS at_risk, round(jump, 9) AS jump, round(sum(jump) OVER (ORDER BY time), 6) AS cumhaz FROM st""")
def q_breslow_weighted(spark, sf):
    b = survival.breslow(pars(spark, sf), "eta1", 1 / (1 + F.abs("z_bal")))
    return b.select("time", r("num"), r("at_risk"), r("jump", 9), r("cumhaz"))


@query("shared_breslow_two_cluster", f"WITH {HAZ} SELECT time, round(den, 6) AS at_risk, round(jump, 9) AS jump, round(cumhaz, 6) AS cumhaz FROM haz WHERE num > 0")
def q_shared(spark, sf):
    b = survival.shared_breslow(pars(spark, sf), [F.col("eta1"), F.col("eta2")], [F.lit(PI[0]), F.lit(PI[1])])
    return b.select("time", r("at_risk"), r("jump", 9), r("cumhaz"))


@query("capped_baseline", f"""WITH {PARS}, bt AS (SELECT time, sum(status) AS num, sum(exp(eta1)) AS w FROM pars GROUP BY time),
rs AS (SELECT time, num, sum(w) OVER (ORDER BY time DESC) AS den FROM bt),
st AS (SELECT time, num, least(num / greatest(den, 5.0), 0.02) AS jump FROM rs),
cs AS (SELECT *, sum(jump) OVER (ORDER BY time) AS raw FROM st)
SELECT time, round(jump, 9) AS jump, round(least(raw, 3.0), 6) AS cumhaz, raw > 3.0 AS capped FROM cs WHERE num > 0""")
def q_capped(spark, sf):
    p = pars(spark, sf)
    s = survival.hazard_steps(survival.time_table(p, F.lit(1.0), F.exp("eta1")), max_jump=0.02, max_cumhaz=3.0, denom_floor=5.0)
    return s.where("events > 0").select("time", r("jump", 9), r("cumhaz"), (F.col("raw_cumhaz") > 3.0).alias("capped"))


@query("baseline_guards", f"""WITH {PARS}, bt AS (SELECT time, sum(status) AS num, sum(exp(eta1)) AS w FROM pars GROUP BY time),
rs AS (SELECT time, num, sum(w) OVER (ORDER BY time DESC) AS den FROM bt),
st AS (SELECT num, den, num / greatest(den, 5.0) AS raw, time FROM rs),
cs AS (SELECT *, sum(least(raw, 0.02)) OVER (ORDER BY time) AS cum FROM st)
SELECT count_if(raw > 0.02)::BIGINT AS max_jump, count_if(cum > 3.0)::BIGINT AS max_cumhaz, count_if(den < 5.0 AND num > 0)::BIGINT AS denom_floor,
  count(*) AS checked FROM cs WHERE num > 0""")
def q_guards(spark, sf):
    p = pars(spark, sf)
    caps = {"max_jump": 0.02, "max_cumhaz": 3.0, "denom_floor": 5.0}
    return survival.guard_counts(survival.hazard_steps(survival.time_table(p, F.lit(1.0), F.exp("eta1")), **caps), **caps)


_ASK = """, ask AS (SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_extendedprice / 50.0 - 5 AS t FROM lineitem),
grid AS (SELECT * FROM haz WHERE num > 0)"""


def _asks(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"), (F.col("l_extendedprice") / 50.0 - 5).alias("t"))


@query("cumhaz_asof", f"""WITH {HAZ}{_ASK} SELECT k, line, part, supp, round(coalesce(grid.cumhaz, 0), 6) AS cumhaz
  FROM ask ASOF LEFT JOIN grid ON ask.t >= grid.time""")
def q_cumhaz_asof(spark, sf):
    base = steps_of(pars(spark, sf)).where("events > 0")
    return survival.cumhaz_at(_asks(spark, sf), base, "t").select("k", "line", "part", "supp", r("cumhaz"))


@query("jump_asof", f"""WITH {HAZ}{_ASK} SELECT k, line, part, supp, round(coalesce(grid.jump, (SELECT arg_min(jump, time) FROM grid)), 9) AS jump
  FROM ask ASOF LEFT JOIN grid ON ask.t >= grid.time""")
def q_jump_asof(spark, sf):
    base = steps_of(pars(spark, sf)).where("events > 0")
    return survival.jump_at(_asks(spark, sf), base, "t").select("k", "line", "part", "supp", r("jump", 9))


@query("log_surv_density", f"WITH {EVID} SELECT id, round(s1, 6) AS s1, round(s2, 6) AS s2 FROM ev")
def q_logdens(spark, sf):
    return evidence(spark, sf).select("id", r("s1"), r("s2"))


@query("martingale_residual", f"WITH {EVID} SELECT id, round(status - cumhaz * exp(eta1), 6) AS residual FROM ev")
def q_martingale(spark, sf):
    p = pars(spark, sf)
    rows = survival.attach_steps(p, steps_of(p))
    return rows.select("id", F.round(F.col("status") - F.col("cumhaz") * F.exp("eta1"), 6).alias("residual"))


@query("partial_loglik", f"""WITH {PARS}, bt AS (SELECT time, sum(status) AS d, sum(status * eta1) AS e, sum(exp(eta1)) AS w FROM pars GROUP BY time),
rs AS (SELECT *, sum(w) OVER (ORDER BY time DESC) AS den FROM bt) SELECT round(sum(e - d * ln(den)), 4) AS partial_loglik FROM rs WHERE d > 0""")
def q_partial(spark, sf):
    return survival.partial_loglik(pars(spark, sf), "eta1").select(r("partial_loglik", 4))


@query("cox_score", f"""WITH {PARS}, bt AS (SELECT time, sum(status) AS d, sum(exp(eta1)) AS s0, """ + ", ".join(
    f"sum(status * {z}) AS e_{z}, sum(exp(eta1) * {z}) AS s_{z}" for z in BETA) + """ FROM pars GROUP BY time),
rs AS (SELECT *, sum(s0) OVER (ORDER BY time DESC) AS c0, """ + ", ".join(
    f"sum(s_{z}) OVER (ORDER BY time DESC) AS c_{z}" for z in BETA) + " FROM bt) SELECT " + ", ".join(
    f"round(sum(e_{z} - d * c_{z} / c0), 4) AS g_{z}" for z in BETA) + " FROM rs WHERE d > 0")
def q_cox_score(spark, sf):
    from mixhaz.operators.prefix import cut, running_totals

    p = pars(spark, sf)
    by = p.groupBy("time").agg(F.sum("status").alias("d"), F.sum(F.exp("eta1")).alias("s0"), *[
        e for z in BETA for e in (F.sum(F.col("status") * F.col(z)).alias(f"e_{z}"),
                                  F.sum(F.exp("eta1") * F.col(z)).alias(f"s_{z}"))]).persist()
    run = running_totals(cut(by, "time"), ["time"], {"c0": "s0", **{f"c_{z}": f"s_{z}" for z in BETA}}, descending=True)
    return run.where("d > 0").agg(*[
        F.round(F.sum(F.col(f"e_{z}") - F.col("d") * F.col(f"c_{z}") / F.col("c0")), 4).alias(f"g_{z}") for z in BETA])


_KM = """kb AS (SELECT time, count(*) AS n, sum(1 - status) AS d FROM spell GROUP BY time),
kr AS (SELECT time, d, sum(n) OVER (ORDER BY time DESC) AS risk FROM kb),
km AS (SELECT time, d, risk, CASE WHEN sum(CASE WHEN d >= risk THEN 1 ELSE 0 END) OVER (ORDER BY time) > 0 THEN 0.0
  ELSE exp(sum(CASE WHEN d < risk THEN ln(1 - d / risk::DOUBLE) ELSE 0 END) OVER (ORDER BY time)) END AS surv FROM kr)"""


@query("km_censoring", f"WITH {SPELL}, {_KM} SELECT time, risk::DOUBLE AS n_risk, d::DOUBLE AS n_event, round(surv, 9) AS surv FROM km")
def q_km(spark, sf):
    return survival.kaplan_meier(spell(spark, sf), 1 - F.col("status")).select("time", "n_risk", "n_event", r("surv", 9))


def u_sql(seed: str, ident: str = "id") -> str:
    return f"((('0x' || substr(md5('{seed}|' || {ident}), 1, 12))::UBIGINT)::DOUBLE + 0.5) / 281474976710656.0"


@query("inverse_hazard_draw", f"""WITH {HAZ}, grid AS (SELECT * FROM haz WHERE num > 0),
q AS (SELECT id, -ln({u_sql('7e')}) / exp(eta1) AS h FROM pars)
SELECT id, grid.time AS draw FROM q ASOF LEFT JOIN grid ON q.h <= grid.cumhaz""")
def q_inverse_hazard(spark, sf):
    p = pars(spark, sf)
    need = p.select("id", (-F.log(X.hash_uniform("7e", "id")) / F.exp("eta1")).alias("h"))
    return survival.inverse_hazard_draw(need, "h", steps_of(p).where("events > 0")).select("id", "draw")


@query("inverse_km_draw", f"""WITH {SPELL}, {_KM}, falls AS (SELECT -surv AS f, min(time) AS time FROM km GROUP BY 1),
q AS (SELECT id, -({u_sql('7c')}) AS u FROM spell)
SELECT id, falls.time AS draw FROM q ASOF LEFT JOIN falls ON q.u <= falls.f""")
def q_inverse_km(spark, sf):
    s = spell(spark, sf)
    curve = survival.kaplan_meier(s, 1 - F.col("status"))
    asked = s.select("id", X.hash_uniform("7c", "id").alias("u"))
    return survival.inverse_survival_draw(asked, "u", curve).select("id", "draw")


@query("concordance", f"""WITH {PARS}, a AS (SELECT time AS t, eta1 AS e FROM pars WHERE status = 1),
p AS (SELECT count(*) AS comparable, count_if(b.eta1 < a.e) AS concordant, count_if(b.eta1 = a.e) AS tied
  FROM a JOIN pars b ON b.time > a.t),
s AS (SELECT count(*) AS comparable, count_if(b.eta1 < a.e) AS concordant, count_if(b.eta1 = a.e) AS tied
  FROM a JOIN pars b ON b.time = a.t AND b.status = 0)
SELECT (p.comparable + s.comparable)::DOUBLE AS comparable, (p.concordant + s.concordant)::DOUBLE AS concordant,
  (p.tied + s.tied)::DOUBLE AS tied, round((p.concordant + s.concordant + (p.tied + s.tied) / 2.0) / (p.comparable + s.comparable), 9) AS concordance FROM p, s""")
def q_concordance(spark, sf):
    return survival.concordance(pars(spark, sf), "eta1").select("comparable", "concordant", "tied", r("concordance", 9))


# ---------------------------------------------------------------- mixture steps

@query("gmm_log_evidence_diag", f"WITH {EVID} SELECT id, round(g1, 6) AS g1, round(g2, 6) AS g2 FROM ev")
def q_gmm(spark, sf):
    z = scaled(spark, sf)
    g = mixture.feature_evidence([F.col(c) for c in CLUSTER_FEATURES], PI, MU, [_diag(v) for v in VAR], RIDGE)
    return z.select("id", F.round(g[0], 6).alias("g1"), F.round(g[1], 6).alias("g2"))


_FULL = ((1.0, 0.3, -0.2), (0.3, 1.2, 0.1), (-0.2, 0.1, 0.8))


def _full_sql() -> str:
    import numpy as np

    s = np.array(_FULL) + RIDGE * np.eye(3)
    inv, logdet = np.linalg.inv(s), float(np.linalg.slogdet(s)[1])
    c = [f"({z} - ({m}))" for z, m in zip(CLUSTER_FEATURES, MU[0])]
    quad = " + ".join(f"({inv[i][j]!r}) * {c[i]} * {c[j]}".replace("np.float64", "") for i in range(3) for j in range(3))
    return f"-0.5 * (3 * ln(2 * pi()) + ({logdet!r}) + {quad})"


@query("gaussian_log_full", f"WITH {SCALED} SELECT id, round({_full_sql()}, 6) AS logdens FROM z")
def q_gmm_full(spark, sf):
    g = X.gaussian_log([F.col(c) for c in CLUSTER_FEATURES], MU[0], mixture.inverse_factor(_FULL, RIDGE))
    return scaled(spark, sf).select("id", F.round(g, 6).alias("logdens"))


@query("estep_tau", f"WITH {TAU} SELECT id, round(tau1, 6) AS tau1, round(tau2, 6) AS tau2 FROM tau")
def q_tau(spark, sf):
    return memberships(spark, sf).select("id", r("tau1"), r("tau2"))


@query("tau_tempered", f"WITH {TAU} SELECT id, round(1 / (1 + exp((g2 + 2 * s2 - g1 - 2 * s1) / 1.5)), 6) AS tau1 FROM tau")
def q_tau_tempered(spark, sf):
    return memberships(spark, sf, gamma=2.0, temp=1.5).select("id", r("tau1"))


@query("update_pi", f"WITH {TAU}, m AS (SELECT greatest(avg(tau1), 0.02) AS a, greatest(avg(tau2), 0.02) AS b FROM tau) SELECT round(a / (a + b), 6) AS pi_1, round(b / (a + b), 6) AS pi_2 FROM m")
def q_pi(spark, sf):
    return mixture.mixing_weights(memberships(spark, sf), ["tau1", "tau2"]).select(r("pi_1"), r("pi_2"))


@query("evidence_score", f"WITH {TAU} SELECT round(sum(greatest(l1, l2) + ln(1 + exp(-abs(l1 - l2)))), 4) AS score FROM tau")
def q_score(spark, sf):
    return memberships(spark, sf).agg(F.round(F.sum(mixture.evidence_score([F.col("l1"), F.col("l2")])), 4).alias("score"))


@query("hard_cluster_argmax", f"WITH {TAU} SELECT id, CASE WHEN tau1 >= tau2 THEN 1 ELSE 2 END AS cluster FROM tau")
def q_hard(spark, sf):
    return memberships(spark, sf).select("id", X.first_argmax([F.col("tau1"), F.col("tau2")]).alias("cluster"))


@query("effective_events", f"WITH {TAU} SELECT round(sum(tau1 * status), 4) AS eff_1, round(sum(tau2 * status), 4) AS eff_2, round(avg(greatest(tau1, tau2)), 6) AS sharpness FROM tau")
def q_eff(spark, sf):
    return memberships(spark, sf).agg(
        F.round(F.sum(F.col("tau1") * F.col("status")), 4).alias("eff_1"),
        F.round(F.sum(F.col("tau2") * F.col("status")), 4).alias("eff_2"),
        F.round(F.avg(F.greatest("tau1", "tau2")), 6).alias("sharpness"))


_MOM = " UNION ALL ".join(
    f"SELECT {k} AS cluster, '{z}' AS feature, round(sum(tau{k}), 4) AS weight_sum, round(sum(tau{k} * {z}) / sum(tau{k}), 6) AS mean, "
    f"round(sum(tau{k} * {z} * {z}) / sum(tau{k}) - (sum(tau{k} * {z}) / sum(tau{k})) ** 2 + 1e-6, 6) AS variance FROM tau"
    for k in (1, 2) for z in CLUSTER_FEATURES)


@query("gmm_weighted_moments", f"WITH {TAU} {_MOM}")
def q_moments(spark, sf):
    m = mixture.weighted_moments(memberships(spark, sf), CLUSTER_FEATURES, ["tau1", "tau2"])
    return m.select("cluster", "feature", r("weight_sum", 4), r("mean"), r("variance"))


@query("one_em_iteration_gmm", f"""WITH {EVID}, tau AS (SELECT *, 1 / (1 + exp(g2 - g1)) AS tau1, 1 / (1 + exp(g1 - g2)) AS tau2 FROM ev) {_MOM}""")
def q_em_step(spark, sf):
    z = scaled(spark, sf)
    g = mixture.feature_evidence([F.col(c) for c in CLUSTER_FEATURES], PI, MU, [_diag(v) for v in VAR], RIDGE)
    t = X.softmax(g)
    rows = z.select("*", t[0].alias("tau1"), t[1].alias("tau2"))
    m = mixture.weighted_moments(rows, CLUSTER_FEATURES, ["tau1", "tau2"])
    return m.select("cluster", "feature", r("weight_sum", 4), r("mean"), r("variance"))


@query("poisson_score", f"WITH {TAU} " + " UNION ALL ".join(
    f"SELECT {k} AS cluster, '{z}' AS feature, round(sum(tau{k} * (status - greatest(cumhaz, 1e-10) * exp(eta{k})) * {z}), 4) AS gradient, "
    f"round(sum(tau{k} * greatest(cumhaz, 1e-10) * exp(eta{k}) * {z} * {z}), 4) AS curvature FROM tau" for k in (1, 2) for z in BETA))
def q_poisson(spark, sf):
    t = memberships(spark, sf)
    picks, cells = [], []
    for k in (1, 2):
        mean = F.greatest("cumhaz", F.lit(1e-10)) * F.exp(f"eta{k}")
        for z in BETA:
            picks += [F.sum(F.col(f"tau{k}") * (F.col("status") - mean) * F.col(z)).alias(f"g{k}{z}"),
                      F.sum(F.col(f"tau{k}") * mean * F.col(z) * F.col(z)).alias(f"h{k}{z}")]
            cells.append(F.struct(F.lit(k).alias("cluster"), F.lit(z).alias("feature"),
                                  F.round(f"g{k}{z}", 4).alias("gradient"), F.round(f"h{k}{z}", 4).alias("curvature")))
    return t.agg(*picks).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


# ---------------------------------------------------------------- prediction

_PRED = EVID + ",\npr AS (SELECT *, 1 / (1 + exp(g2 - g1)) AS t1, 1 / (1 + exp(g1 - g2)) AS t2 FROM ev)"


def _predicted(spark, sf):
    p = pars(spark, sf)
    g = mixture.feature_evidence([F.col(c) for c in CLUSTER_FEATURES], PI, MU, [_diag(v) for v in VAR], RIDGE, pi_min=1e-12)
    t = X.softmax(mixture.sanitise(g))
    return p.select("*", t[0].alias("t1"), t[1].alias("t2"))


@query("predict_tau", f"WITH {_PRED} SELECT id, round(t1, 6) AS tau_1, round(t2, 6) AS tau_2 FROM pr")
def q_predict_tau(spark, sf):
    return _predicted(spark, sf).select("id", F.round("t1", 6).alias("tau_1"), F.round("t2", 6).alias("tau_2"))


@query("predict_lp", f"WITH {_PRED} SELECT id, round(t1 * greatest(least(eta1, 12), -12) + t2 * greatest(least(eta2, 12), -12), 6) AS lp FROM pr")
def q_predict_lp(spark, sf):
    p = _predicted(spark, sf)
    lp = F.col("t1") * X.clamp(F.col("eta1"), 12) + F.col("t2") * X.clamp(F.col("eta2"), 12)
    return p.select("id", F.round(lp, 6).alias("lp"))


@query("predict_survival", f"WITH {_PRED}, " + ", ".join(
    f"h{i} AS (SELECT coalesce(max(cumhaz), 0) AS h FROM haz WHERE num > 0 AND time <= {t})" for i, t in enumerate(PREDICT_TIMES))
    + " SELECT id, " + ", ".join(f"round(t1 * exp(-h{i}.h * exp(eta1)) + t2 * exp(-h{i}.h * exp(eta2)), 6) AS s_{i}"
                                 for i in range(len(PREDICT_TIMES))) + " FROM pr, h0, h1, h2")
def q_predict_survival(spark, sf):
    p = _predicted(spark, sf)
    grid = steps_of(p.select("id", "time", "status", "eta1", "eta2")).where("events > 0")
    at = grid.agg(*[F.coalesce(F.max(F.when(F.col("time") <= t, F.col("cumhaz"))), F.lit(0.0)).alias(f"h{i}")
                    for i, t in enumerate(PREDICT_TIMES)]).first()
    return p.select("id", *[F.round(F.col("t1") * F.exp(-at[i] * F.exp("eta1")) + F.col("t2") * F.exp(-at[i] * F.exp("eta2")), 6)
                            .alias(f"s_{i}") for i in range(len(PREDICT_TIMES))])


# ---------------------------------------------------------------- folds and resampling

_FOLD = f"fl AS (SELECT id, status, ((row_number() OVER (PARTITION BY status ORDER BY {u_sql('11')}, id) - 1) % 5 + 1)::INTEGER AS fold FROM spell)"


@query("stratified_folds", f"WITH {SPELL}, {_FOLD} SELECT id, fold FROM fl")
def q_folds(spark, sf):
    return resample.stratified_folds(spell(spark, sf).select("id", "status"), 5, "11").select("id", "fold")


@query("fold_balance", f"WITH {SPELL}, {_FOLD} SELECT fold, count(*) AS n, sum(status)::BIGINT AS events FROM fl GROUP BY fold")
def q_fold_balance(spark, sf):
    f = resample.stratified_folds(spell(spark, sf).select("id", "status"), 5, "11")
    return f.groupBy("fold").agg(F.count("*").alias("n"), F.sum("status").alias("events"))


@query("balanced_labels", f"WITH {SPELL} SELECT id, ((row_number() OVER (ORDER BY {u_sql('5')}, id) - 1) % 3)::INTEGER AS label FROM spell")
def q_labels(spark, sf):
    return resample.balanced_labels(spell(spark, sf).select("id"), 3, "5")


@query("permute_outcome", f"""WITH {SPELL}, a AS (SELECT id, row_number() OVER (ORDER BY {u_sql('3t')}, id) AS pos FROM spell),
b AS (SELECT time, status, row_number() OVER (ORDER BY {u_sql('3g')}, id) AS pos FROM spell) SELECT a.id, b.time, b.status FROM a JOIN b USING (pos)""")
def q_permute(spark, sf):
    return resample.permute_outcome(spell(spark, sf).select("id", "time", "status"), "3").select("id", "time", "status")


@query("bootstrap_k1", f"""WITH {HAZ}, {_KM}, grid AS (SELECT * FROM haz WHERE num > 0), falls AS (SELECT -surv AS f, min(time) AS time FROM km GROUP BY 1),
q AS (SELECT id, -ln({u_sql('9e')}) / exp(eta1) AS h, -({u_sql('9c')}) AS u FROM pars),
e AS (SELECT q.id, q.u, grid.time AS ev FROM q ASOF LEFT JOIN grid ON q.h <= grid.cumhaz),
c AS (SELECT e.id, e.ev, falls.time AS ce FROM e ASOF LEFT JOIN falls ON e.u <= falls.f),
m AS (SELECT max(time) AS tmax FROM spell)
SELECT id, least(coalesce(ev, 1e300), coalesce(ce, 1e300), tmax) AS time,
  (coalesce(ev, 1e300) <= coalesce(ce, 1e301) AND coalesce(ev, 1e300) <= tmax)::INTEGER AS status FROM c, m""")
def q_bootstrap(spark, sf):
    p = pars(spark, sf)
    base = steps_of(p).where("events > 0")
    cens = survival.kaplan_meier(p.select("time", "status"), 1 - F.col("status"))
    last = p.agg(F.max("time").alias("t")).first()["t"]
    return resample.bootstrap_outcome(p, "9", F.col("eta1"), base, cens, last).select("id", "time", "status")


@query("bootstrap_k2", f"""WITH {_PRED}, {_KM}, grid AS (SELECT * FROM haz WHERE num > 0), falls AS (SELECT -surv AS f, min(time) AS time FROM km GROUP BY 1),
dz AS (SELECT id, CASE WHEN {u_sql('z9')} <= t1 THEN 1 ELSE 2 END AS cluster, eta1, eta2 FROM pr),
q AS (SELECT id, cluster, -ln({u_sql('9e')}) / exp(CASE cluster WHEN 1 THEN eta1 ELSE eta2 END) AS h, -({u_sql('9c')}) AS u FROM dz),
e AS (SELECT q.*, grid.time AS ev FROM q ASOF LEFT JOIN grid ON q.h <= grid.cumhaz),
c AS (SELECT e.*, falls.time AS ce FROM e ASOF LEFT JOIN falls ON e.u <= falls.f),
m AS (SELECT max(time) AS tmax FROM spell)
SELECT id, cluster, least(coalesce(ev, 1e300), coalesce(ce, 1e300), tmax) AS time,
  (coalesce(ev, 1e300) <= coalesce(ce, 1e301) AND coalesce(ev, 1e300) <= tmax)::INTEGER AS status FROM c, m""")
def q_bootstrap_two(spark, sf):
    """Outcomes of a two-cluster model: the cluster is drawn by membership, then times from its hazard."""
    p = _predicted(spark, sf)
    base = steps_of(p).where("events > 0")
    cens = survival.kaplan_meier(p.select("time", "status"), 1 - F.col("status"))
    last = p.agg(F.max("time").alias("t")).first()["t"]
    z, eta = resample.drawn_cluster(X.hash_uniform("z9", "id"), [F.col("t1"), F.col("t2")], [F.col("eta1"), F.col("eta2")])
    rows = p.withColumn("cluster", z).withColumn("_eta", eta)
    return resample.bootstrap_outcome(rows, "9", F.col("_eta"), base, cens, last).select("id", "cluster", "time", "status")


# ---------------------------------------------------------------- metrics

@query("adjusted_rand", f"""WITH {TAU}, lab AS (SELECT CASE WHEN tau1 >= tau2 THEN 1 ELSE 2 END AS a, i_building AS b FROM tau JOIN spell USING (id)),
ct AS (SELECT a, b, count(*)::DOUBLE AS n FROM lab GROUP BY 1, 2),
ra AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT a, sum(n) AS n FROM ct GROUP BY a)), cb AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT b, sum(n) AS n FROM ct GROUP BY b)),
ab AS (SELECT sum(n * (n - 1) / 2) AS v, sum(n) * (sum(n) - 1) / 2 AS t FROM ct)
SELECT round((ab.v - ra.v * cb.v / ab.t) / ((ra.v + cb.v) / 2 - ra.v * cb.v / ab.t), 6) AS ari FROM ra, cb, ab""")
def q_ari(spark, sf):
    m = memberships(spark, sf).select("id", X.first_argmax([F.col("tau1"), F.col("tau2")]).alias("a"))
    lab = m.join(spell(spark, sf).select("id", F.col(INDICATOR).alias("b")), "id")
    return metrics.adjusted_rand(lab, "a", "b").select(r("ari"))


@query("degeneracy", f"""WITH {TAU}, h AS (SELECT *, CASE WHEN tau1 >= tau2 THEN 1 ELSE 2 END AS c FROM tau)
SELECT least(count_if(c = 1), count_if(c = 2))::BIGINT AS min_size, least(sum(CASE WHEN c = 1 THEN status ELSE 0 END), sum(CASE WHEN c = 2 THEN status ELSE 0 END))::BIGINT AS min_events,
 round(least(sum(tau1), sum(tau2)), 4) AS min_eff_size, round(least(sum(tau1 * status), sum(tau2 * status)), 4) AS min_eff_events,
 least(count_if(c = 1), count_if(c = 2)) < 10 OR least(sum(CASE WHEN c = 1 THEN status ELSE 0 END), sum(CASE WHEN c = 2 THEN status ELSE 0 END)) < 5 AS degenerate FROM h""")
def q_degeneracy(spark, sf):
    m = memberships(spark, sf).withColumn("c", X.first_argmax([F.col("tau1"), F.col("tau2")]))
    return metrics.cluster_health(m, "c", ["tau1", "tau2"], 2).select(
        "min_size", "min_events", r("min_eff_size", 4), r("min_eff_events", 4), "degenerate")


@query("mse_lp", f"WITH {PARS} SELECT round(avg((eta1 - eta2) ** 2) - avg(eta1 - eta2) ** 2, 6) AS mse FROM pars")
def q_mse(spark, sf):
    return metrics.mse_up_to_level(pars(spark, sf), F.col("eta1"), F.col("eta2")).select(r("mse"))


@query("bic_by_segment", f"""WITH {TAU}, seg AS (SELECT i_building AS seg, sum(greatest(l1, l2) + ln(1 + exp(-abs(l1 - l2)))) AS ll, count(*) AS n FROM tau JOIN spell USING (id) GROUP BY 1)
SELECT seg, round(-2 * ll + (1 + 2 * 2 * 3 + 2 * 4) * ln(n), 3) AS bic FROM seg""")
def q_bic(spark, sf):
    m = memberships(spark, sf).withColumn("ll", mixture.evidence_score([F.col("l1"), F.col("l2")]))
    seg = m.join(spell(spark, sf).select("id", F.col(INDICATOR).alias("seg")), "id").groupBy("seg").agg(
        F.sum("ll").alias("ll"), F.count("*").cast("double").alias("n"))
    return seg.select("seg", F.round(metrics.bic(F.col("ll"), F.col("n"), 2, 3, 4), 3).alias("bic"))


# ---------------------------------------------------------------- summaries of result tables

@query("cell_means", f"""WITH {TRIAL} SELECT cell, method, p, count(*) AS reps, round(avg(recovery), 6) AS recovery, round(stddev_samp(recovery) / sqrt(count(recovery)), 6) AS recovery_mcse,
 round(avg(ari), 6) AS ari, round(stddev_samp(ari) / sqrt(count(ari)), 6) AS ari_mcse, round(avg(mse_eta), 6) AS mse_eta, round(stddev_samp(mse_eta) / sqrt(count(mse_eta)), 6) AS mse_eta_mcse
 FROM trial WHERE NOT failed AND NOT degenerate GROUP BY 1, 2, 3""")
def q_cell_means(spark, sf):
    m = summaries.cell_means(trial(spark, sf), ["cell", "method", "p"], ["recovery", "ari", "mse_eta"])
    return m.select("cell", "method", "p", "reps", *[r(c) for c in m.columns[4:]])


@query("share_of_oracle", f"""WITH {TRIAL}, m AS (SELECT cell, method, p, avg(recovery) AS recovery, stddev_samp(recovery) / sqrt(count(recovery)) AS se FROM trial WHERE NOT failed AND NOT degenerate GROUP BY 1, 2, 3),
o AS (SELECT *, max(CASE WHEN method = 'oracle' THEN recovery END) OVER (PARTITION BY cell) AS ref, sqrt(2 / (pi() * p)) AS fl FROM m)
SELECT cell, method, round(ref, 6) AS reference, round(100 * (recovery - fl) / (ref - fl), 4) AS pct, round(100 * se / (ref - fl), 4) AS pct_mcse FROM o""")
def q_share(spark, sf):
    m = summaries.cell_means(trial(spark, sf), ["cell", "method", "p"], ["recovery"])
    s = summaries.share_of_reference(m, ["cell"], "oracle")
    return s.select("cell", "method", r("reference"), r("pct", 4), r("pct_mcse", 4))


@query("degenerate_scoring", f"""WITH {TRIAL} SELECT cell, method, round(avg(CASE WHEN NOT degenerate THEN recovery END), 6) AS excluded,
 round(avg(CASE WHEN degenerate THEN sqrt(2 / (pi() * p)) ELSE recovery END), 6) AS floored, round(avg(recovery), 6) AS as_scored FROM trial WHERE NOT failed GROUP BY 1, 2""")
def q_degenerate_scoring(spark, sf):
    t = trial(spark, sf).where(~F.col("failed"))
    marked = t.withColumn("raw", F.col("recovery"))
    floored = summaries.score_degenerate(marked, "floor")
    return floored.groupBy("cell", "method").agg(
        F.round(F.avg(F.when(~F.col("degenerate"), F.col("raw"))), 6).alias("excluded"),
        F.round(F.avg("recovery"), 6).alias("floored"), F.round(F.avg("raw"), 6).alias("as_scored"))


@query("pivot_recovery", f"WITH {WIDE} SELECT cell, rep, " + ", ".join(f"round({m}, 6) AS {m}" for m in METHODS) + " FROM wide")
def q_pivot(spark, sf):
    w = summaries.wide(trial(spark, sf), ["cell"], METHODS)
    return w.select("cell", "rep", *[r(m) for m in METHODS])


_DIFFS = WIDE + ",\nd AS (" + " UNION ALL ".join(
    f"SELECT cell, '{c}' AS comparator, joint - {c} AS d FROM wide" for c in ("features_only", "two_stage", "single")) + """),
pd AS (SELECT cell, comparator, count(d) AS pairs, stddev_samp(d) / sqrt(count(d)) AS diff_mcse, avg(CASE WHEN d > 0 THEN 1.0 WHEN d <= 0 THEN 0.0 END) AS win, avg(d) AS diff FROM d GROUP BY 1, 2)"""


def _diffs(spark, sf):
    w = summaries.wide(trial(spark, sf), ["cell"], METHODS)
    return summaries.paired_differences(w, ["cell"], "joint", ["features_only", "two_stage", "single"])


@query("paired_differences", f"WITH {_DIFFS} SELECT cell, comparator, pairs, round(diff_mcse, 6) AS diff_mcse, round(win, 6) AS win, round(diff, 6) AS diff FROM pd")
def q_paired(spark, sf):
    return _diffs(spark, sf).select("cell", "comparator", "pairs", r("diff_mcse"), r("win"), r("diff"))


@query("verdict_rollup", f"""WITH {_DIFFS}, v AS (SELECT cell, bool_or(abs(diff) > 2 * diff_mcse AND diff > 0) AS b, bool_or(abs(diff) > 2 * diff_mcse AND diff < 0) AS w FROM pd GROUP BY 1)
SELECT cell, CASE WHEN b IS NULL THEN NULL WHEN b AND w THEN 'mixed' WHEN b THEN 'beats' WHEN w THEN 'loses' ELSE 'matches' END AS verdict FROM v""")
def q_verdict(spark, sf):
    return summaries.verdicts(_diffs(spark, sf), ["cell"])


@query("normalised_gain", f"""WITH {WIDE}, ab AS (SELECT cell, joint - features_only AS a, oracle - features_only AS b FROM wide),
g AS (SELECT cell, count(*) AS pairs, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c, avg(a) AS ma, avg(b) AS mb FROM ab WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1)
SELECT cell, pairs, round(ma, 6) AS ma, round(mb, 6) AS mb, round(ma / mb, 4) AS norm_gain, round(sqrt(greatest(va - 2 * (ma / mb) * c + (ma / mb) ** 2 * vb, 0) / pairs) / abs(mb), 4) AS norm_mcse FROM g""")
def q_gain(spark, sf):
    w = summaries.wide(trial(spark, sf), ["cell"], METHODS)
    g = summaries.normalised_gain(w, ["cell"], "joint", "features_only", "oracle")
    return g.select("cell", "pairs", r("ma"), r("mb"), r("norm_gain", 4), r("norm_mcse", 4))


_PV = TRIAL + """,
pv AS (SELECT cell, rep, ari AS p_bootstrap, CASE WHEN NOT failed THEN mse_eta END AS p_permutation, method FROM trial),
pl AS (SELECT cell, rep, method, 'bootstrap' AS null_kind, p_bootstrap AS pval FROM pv UNION ALL SELECT cell, rep, method, 'permutation', p_permutation FROM pv)"""


def _pvalues(spark, sf):
    t = trial(spark, sf).select("cell", "rep", "method", F.col("ari").alias("bootstrap"),
                                F.when(~F.col("failed"), F.col("mse_eta")).alias("permutation"))
    return t.unpivot(["cell", "rep", "method"], ["bootstrap", "permutation"], "null_kind", "pval")


@query("unpivot_pvalues", f"WITH {_PV} SELECT cell, rep, method, null_kind, round(pval, 6) AS pval FROM pl")
def q_unpivot(spark, sf):
    return _pvalues(spark, sf).select("cell", "rep", "method", "null_kind", r("pval"))


@query("rejection_rates", f"""WITH {_PV}, g AS (SELECT cell, null_kind, count(*) AS n, avg(CASE WHEN pval <= 0.05 THEN 1.0 ELSE 0.0 END) AS rate FROM pl WHERE pval IS NOT NULL GROUP BY 1, 2)
SELECT cell, null_kind, n, round(rate, 6) AS rate, round(sqrt(rate * (1 - rate) / n), 6) AS rate_mcse, round(0.05 + 2 * sqrt(0.0475 / n), 6) AS upper, rate <= 0.05 + 2 * sqrt(0.0475 / n) AS ok FROM g""")
def q_rejection(spark, sf):
    g = summaries.rejection_rates(_pvalues(spark, sf), ["cell", "null_kind"])
    return g.select("cell", "null_kind", "n", r("rate"), r("rate_mcse"), r("upper"), "ok")


@query("pvalue_histogram", f"""WITH {_PV}, e AS (SELECT b::INTEGER AS bin, (b - 1) / 20.0::DOUBLE AS lo, b / 20.0::DOUBLE AS hi FROM range(1, 21) r(b))
SELECT bin, count(*) AS n FROM pl JOIN e ON (pval > lo OR bin = 1) AND pval <= hi WHERE pval BETWEEN 0 AND 1 GROUP BY 1""")
def q_hist(spark, sf):
    return summaries.histogram(_pvalues(spark, sf), "pval")


@query("ks_uniform_stat", f"""WITH {TRIAL}, c AS (SELECT recovery AS x, count(*) AS n FROM trial GROUP BY 1),
k AS (SELECT x, n, sum(n) OVER (ORDER BY x) AS cum, sum(n) OVER () AS t FROM c),
d AS (SELECT max(greatest(cum / t::DOUBLE - x, x - (cum - n) / t::DOUBLE)) AS d, max(t) AS t FROM k),
s AS (SELECT d, t, CASE WHEN d <= 0 THEN 1 WHEN t * d * d < 0.25 THEN 1 - sqrt(2 * pi() / (t * d * d)) * (SELECT sum(exp(-((2 * j - 1) * pi()) ** 2 / (8 * t * d * d))) FROM range(1, 60) r(j))
 ELSE (SELECT sum(2 * (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * t * d * d)) FROM range(1, 60) r(j)) END AS pv FROM d)
SELECT round(d, 6) AS d, t::BIGINT AS n, round(least(greatest(pv, 0), 1), 6) AS p_value FROM s""")
def q_ks(spark, sf):
    return summaries.ks_uniform(trial(spark, sf), "recovery").select(r("d"), "n", r("p_value"))


@query("spearman", f"""WITH {SPELL}, rk AS (SELECT rank() OVER (ORDER BY f_disc) + (count(*) OVER (PARTITION BY f_disc) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY time) + (count(*) OVER (PARTITION BY time) - 1) / 2.0 AS b FROM spell) SELECT round(corr(a, b), 6) AS rho FROM rk""")
def q_spearman(spark, sf):
    return summaries.spearman(spell(spark, sf), "f_disc", "time").select(r("rho"))


@query("confusion_matrix", f"""WITH {TRIAL}, best AS (SELECT cell, rep, arg_max(method, (recovery, method)) AS m FROM trial WHERE NOT failed GROUP BY 1, 2),
k AS (SELECT cell, CASE m WHEN 'single' THEN 1 WHEN 'two_stage' THEN 2 WHEN 'features_only' THEN 3 ELSE 4 END AS k FROM best)
SELECT cell, count(*) AS n, """ + ", ".join(f"round(avg(CASE WHEN k = {v} THEN 1.0 ELSE 0.0 END), 6) AS p_{v}" for v in range(1, 5)) + " FROM k GROUP BY 1")
def q_confusion(spark, sf):
    best = trial(spark, sf).where(~F.col("failed")).groupBy("cell", "rep").agg(
        F.max_by("method", F.struct("recovery", "method")).alias("m"))
    code = {"single": 1, "two_stage": 2, "features_only": 3}
    k = F.lit(4)
    for m, v in code.items():
        k = F.when(F.col("m") == m, v).otherwise(k)
    c = summaries.confusion(best.withColumn("k", k), ["cell"], "k", range(1, 5))
    return c.select("cell", "n", *[r(f"p_{v}") for v in range(1, 5)])


@query("grouped_argmax_config", f"""WITH {TRIAL} SELECT cell, method, arg_max(rep, (recovery, -rep)) AS rep, round(max(recovery), 6) AS recovery FROM trial GROUP BY 1, 2""")
def q_argmax(spark, sf):
    t = trial(spark, sf).select("cell", "method", "rep", "recovery")
    return summaries.best_row(t, ["cell", "method"], "recovery", "rep").select("cell", "method", "rep", r("recovery"))


@query("seconds_quantiles", f"WITH {TRIAL} SELECT cell, method, round(quantile_cont(secs, 0.5), 6) AS median_secs, round(quantile_cont(secs, 0.9), 6) AS p90_secs FROM trial GROUP BY 1, 2")
def q_quantiles(spark, sf):
    g = grouped_quantiles(trial(spark, sf), ["cell", "method"], "secs", {"median_secs": 0.5, "p90_secs": 0.9})
    return g.select("cell", "method", r("median_secs"), r("p90_secs"))


@query("worst_cell", f"WITH {TRIAL}, c AS (SELECT cell, method, avg(recovery) AS m FROM trial WHERE NOT failed GROUP BY 1, 2) SELECT method, round(min(m), 6) AS worst, round(avg(m), 6) AS mean FROM c GROUP BY 1")
def q_worst(spark, sf):
    c = trial(spark, sf).where(~F.col("failed")).groupBy("cell", "method").agg(F.avg("recovery").alias("m"))
    return c.groupBy("method").agg(F.round(F.min("m"), 6).alias("worst"), F.round(F.avg("m"), 6).alias("mean"))


@query("wls_law", f"""WITH {TRIAL}, x AS (SELECT ln(recovery / (1 - recovery)) AS y, ln(events) AS x, secs AS w FROM trial WHERE events > 0 AND recovery > 0 AND recovery < 1),
s AS (SELECT sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * y * y) AS syy, count(*) AS n FROM x),
e AS (SELECT *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS b FROM s), f AS (SELECT *, (sy - b * sx) / sw AS a FROM e)
SELECT term, round(v, 5) AS estimate, round(se, 5) AS se, n FROM (
 SELECT '(Intercept)' AS term, a AS v, sqrt((syy - a * sy - b * sxy) / (n - 2) * sxx / (sw * sxx - sx * sx)) AS se, n FROM f
 UNION ALL SELECT 'log_events', b, sqrt((syy - a * sy - b * sxy) / (n - 2) * sw / (sw * sxx - sx * sx)), n FROM f)""")
def q_wls(spark, sf):
    t = trial(spark, sf).where("events > 0 and recovery > 0 and recovery < 1")
    fit = summaries.least_squares(t, F.log(F.col("recovery") / (1 - F.col("recovery"))), {"log_events": F.log("events")}, F.col("secs"))
    rows = list(zip(fit["term"], fit["estimate"], fit["se"]))
    return spark.createDataFrame([(a, round(b, 5), round(c, 5), fit["n"]) for a, b, c in rows],
                                 "term string, estimate double, se double, n bigint")


_MAN = """a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1)"""


@query("manifest_full_outer", f"""WITH a AS (SELECT c_custkey AS k, c_nationkey::BIGINT + 5 AS n FROM customer), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_custkey >= 0 GROUP BY 1)
SELECT k, a.n AS left_value, b.n AS right_value, CASE WHEN a.n IS NULL THEN 'right_only' WHEN b.n IS NULL THEN 'left_only' WHEN a.n = b.n THEN 'same' ELSE 'different' END AS state FROM a FULL OUTER JOIN b USING (k)""")
def q_manifest(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey").cast("long") + 5).alias("n"))
    b = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return summaries.compare_manifests(a, b, ["k"], "n")


@query("bad_replicates_anti", f"""WITH {TRIAL} SELECT cell, count(*) AS rows_kept, count(DISTINCT rep) AS reps_kept FROM trial t
 WHERE NOT EXISTS (SELECT 1 FROM trial b WHERE b.cell = t.cell AND b.rep = t.rep AND b.failed) GROUP BY 1""")
def q_anti(spark, sf):
    t = trial(spark, sf)
    bad = t.where("failed").select("cell", "rep").distinct()
    kept = t.join(bad, ["cell", "rep"], "left_anti")
    # reps are counted from distinct pairs, so no group holds them all
    per_rep = kept.groupBy("cell", "rep").agg(F.count("*").alias("n"))
    return per_rep.groupBy("cell").agg(F.sum("n").alias("rows_kept"), F.count("*").alias("reps_kept"))


@query("completed_semi", f"""WITH {TRIAL} SELECT cell, method, count(*) AS n FROM trial t WHERE EXISTS (SELECT 1 FROM trial o WHERE o.cell = t.cell AND o.rep = t.rep AND o.method = 'oracle' AND NOT o.failed) GROUP BY 1, 2""")
def q_semi(spark, sf):
    t = trial(spark, sf)
    done = t.where("method = 'oracle' and not failed").select("cell", "rep")
    return t.join(done, ["cell", "rep"], "left_semi").groupBy("cell", "method").agg(F.count("*").alias("n"))


@query("matched_cells", f"""WITH {TRIAL}, m AS (SELECT cell, method, round(avg(events)) AS band, count(*) AS n FROM trial GROUP BY 1, 2)
SELECT a.method, a.cell AS cell_a, b.cell AS cell_b, a.n AS n_a, b.n AS n_b FROM m a JOIN m b ON a.method = b.method AND a.cell < b.cell AND abs(a.band - b.band) < 0.5""")
def q_matched(spark, sf):
    m = trial(spark, sf).groupBy("cell", "method").agg(F.round(F.avg("events")).alias("band"), F.count("*").alias("n"))
    a, b = m.alias("a"), m.alias("b")
    close = (F.col("a.cell") < F.col("b.cell")) & (F.abs(F.col("a.band") - F.col("b.band")) < 0.5)
    return a.join(b, (F.col("a.method") == F.col("b.method")) & close).select(
        F.col("a.method").alias("method"), F.col("a.cell").alias("cell_a"), F.col("b.cell").alias("cell_b"),
        F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))


@query("design_cross", """SELECT DISTINCT o_orderpriority AS cell, n, mu_sep, beta_sep, 20260101 + 3 * 1000000 + n * 1000 + 7 AS seed FROM orders,
 (SELECT unnest([200, 400, 800]) AS n), (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS mu_sep), (SELECT unnest([1.0, 2.0])::DOUBLE AS beta_sep)""")
def q_design(spark, sf):
    cells = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("cell")).distinct()
    from mixhaz.operators.simulate import design_grid, replicate_seed

    grid = design_grid(cells, {"n": [200, 400, 800], "mu_sep": [0.0, 0.5, 1.0], "beta_sep": [1.0, 2.0]})
    return grid.withColumn("seed", replicate_seed(F.lit(3), F.col("n"), F.lit(7)).cast("int"))


@query("dataset_hash", """SELECT o_orderpriority AS cell, sum(('0x' || substr(md5(o_orderkey || '|' || o_custkey || '|' || o_orderstatus), 1, 8))::UBIGINT)::BIGINT AS fingerprint, count(*) AS n FROM orders GROUP BY 1""")
def q_hash(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "cell")
    return summaries.dataset_hash(o, ["o_orderkey", "o_custkey", "o_orderstatus"], ["cell"])


# ---------------------------------------------------------------- fits: SQL checks what must hold at the returned parameters

FIT_CLUSTER = ["f_price", "f_lines", "f_disc"]
FIT_HAZARD = ["f_price", "f_bal", "f_qty", INDICATOR]
_TWO = ("C1", "C2")


def _certified(model, clusters: bool = True) -> DataFrame:
    from mixhaz.plans.certificate import certificate

    c = certificate(model)
    rows = (c if clusters else c.where("cluster IS NULL")).select("term", "cluster", "feature", F.round("target", 4).alias("target"), "holds")
    if not clusters:
        rows = rows.unionByName(c.where("cluster IS NOT NULL").agg(F.bool_and("holds").alias("holds")).select(
            F.lit("all_clusters").alias("term"), F.lit(None).cast("string").alias("cluster"), F.lit(None).cast("string").alias("feature"),
            F.lit(None).cast("double").alias("target"), "holds"))
    return rows


def _certificate_sql(hazard, clusters=_TWO, own: bool = False, gate: bool = False) -> str:
    """The rows of a certificate: targets from the data, and every condition met."""
    def row(term, cluster="NULL", feature="NULL", target="NULL"):
        return f"SELECT '{term}' AS term, {cluster}::VARCHAR AS cluster, {feature}::VARCHAR AS feature, round({target}::DOUBLE, 4) AS target, true AS holds FROM t"

    rows = [row("rows", target="n"), row("events", target="e"), row("expected_events", target="e"), row("converged")]
    for c in (f"'{c}'" for c in clusters):
        rows += [row("expected_events_of_cluster", c)] * own
        rows += [row("gate_balance", c)] if gate else [row("weight", c), *[row("cluster_mean", c, f"'{f}'") for f in FIT_CLUSTER]]
        rows += [row("score", c, f"'{f}'") for f in hazard]
    if not clusters:
        rows.append(row("all_clusters"))
    for f in FIT_CLUSTER:
        rows += [row("scaler_mean", feature=f"'{f}'", target=f"m_{f}")] if gate else [
            row("mixture_mean", feature=f"'{f}'", target=f"m_{f}"), row("mixture_sd", feature=f"'{f}'", target=f"s_{f}")]
    moments = ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in FIT_CLUSTER)
    return f"WITH {SPELL}, t AS (SELECT count(*) AS n, sum(status) AS e, {moments} FROM spell) " + " UNION ALL ".join(rows)


@query("fit_mixture_cox", _certificate_sql(FIT_HAZARD))
def q_fit(spark, sf):
    from mixhaz.plans.fitting import fit_mixture

    return _certified(fit_mixture(spell(spark, sf), FIT_CLUSTER, FIT_HAZARD, ident="id", k=2))


@query("fit_cluster_baselines", _certificate_sql(FIT_HAZARD, own=True))
def q_fit_cluster(spark, sf):
    from mixhaz.plans.fitting import fit_mixture

    return _certified(fit_mixture(spell(spark, sf), FIT_CLUSTER, FIT_HAZARD, ident="id", k=2, baseline="cluster", covariance="full"))


@query("fit_elastic_net", _certificate_sql(FIT_HAZARD))
def q_fit_elastic(spark, sf):
    """Scores inside the penalty's subgradient: equal to it at coefficients that are not zero, within it at those that are."""
    from mixhaz.plans.fitting import fit_mixture

    return _certified(fit_mixture(spell(spark, sf), FIT_CLUSTER, FIT_HAZARD, ident="id", k=2, alpha=0.7, lam=0.1))


@query("multistart", "SELECT s::INTEGER AS start, s::INTEGER AS seed, true AS converged, true AS at_most_kept, true AS kept_is_first_best FROM range(1, 5) r(s)")
def q_multistart(spark, sf):
    from mixhaz.plans.fitting import fit_mixture

    m = fit_mixture(spell(spark, sf), FIT_CLUSTER, FIT_HAZARD, ident="id", k=2, n_starts=4, init="random")
    kept = m.starts[m.best_start - 1]["final_score"]
    first = next(s["start"] for s in m.starts if s["final_score"] == kept) == m.best_start
    return spark.createDataFrame([(s["start"], s["seed"], bool(s["converged"]), bool(s["final_score"] <= kept), first) for s in m.starts],
                                 "start int, seed int, converged boolean, at_most_kept boolean, kept_is_first_best boolean")


@query("fitted_scores", f"WITH {SPELL} SELECT id, 1.0::DOUBLE AS memberships, true AS lp_between, true AS survival_falls, true AS converged FROM spell")
def q_fitted_scores(spark, sf):
    """Fit, then score every row: memberships add up, the predictor lies between the clusters' own, survival falls from one time to the next."""
    from mixhaz.plans.fitting import fit_mixture

    s = spell(spark, sf)
    m = fit_mixture(s, FIT_CLUSTER, FIT_HAZARD, ident="id", k=2)
    out = m.predict(m.predict(m.predict(s, "tau"), "lp"), "survival", PREDICT_TIMES)
    eta = m._eta([F.col(c) for c in FIT_HAZARD])
    surv = [F.col(f"`t={t:.4g}`") for t in PREDICT_TIMES]
    falls = (surv[0] <= 1) & (surv[2] >= 0) & (surv[0] >= surv[1]) & (surv[1] >= surv[2])
    return out.select("id", F.round(F.col("tau_1") + F.col("tau_2"), 9).alias("memberships"),
                      F.col("lp").between(F.least(*eta) - 1e-9, F.greatest(*eta) + 1e-9).alias("lp_between"), falls.alias("survival_falls"),
                      F.lit(bool(m.converged)).alias("converged"))


@query("cv_by_fold", f"""WITH {SPELL}, fl AS (SELECT status, ((row_number() OVER (PARTITION BY status ORDER BY {u_sql('fold1')}, id) - 1) % 5 + 1)::INTEGER AS fold FROM spell)
SELECT fold, k::INTEGER AS k, count(*) AS held, sum(status)::BIGINT AS held_events, true AS finite, true AS adds_up, true AS converged FROM fl, range(1, 3) r(k) GROUP BY 1, 2""")
def q_cv(spark, sf):
    from mixhaz.plans.fitting import cross_validate

    s = spell(spark, sf)
    cv = cross_validate(s, FIT_CLUSTER, FIT_HAZARD, ident="id", ks=(1, 2), nfolds=5, criterion="joint")
    sizes = resample.stratified_folds(s.select("id", "status"), 5, f"fold{cv.seed}").groupBy("fold").agg(
        F.count("*").alias("held"), F.sum("status").cast("long").alias("held_events"))
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    got = cv.frame(spark).select("fold", "k", finite.alias("finite"), (F.abs(F.col("partial") + F.col("gmm") - F.col("value")) < 1e-6).alias("adds_up"), "converged")
    return got.join(sizes, "fold")


@query("run_cv_final_model", _certificate_sql(FIT_HAZARD, clusters=()))
def q_run_cv(spark, sf):
    """The number of clusters is chosen by the folds; the certificate of the final model holds for whichever it is."""
    from mixhaz.plans.fitting import final_model, run_cv
    from mixhaz.sources.readers import assign_roles

    prepared = assign_roles(spell(spark, sf).drop("id"), "time", "status", INDICATOR)
    cv = run_cv(prepared, vargmm=FIT_CLUSTER, varcox=["f_price", "f_bal", "f_qty"])
    return _certified(final_model(cv, prepared, FIT_CLUSTER, ["f_price", "f_bal", "f_qty"]), clusters=False)


@query("heterogeneity_test")
def q_test(spark, sf):
    from mixhaz.plans.inference import heterogeneity_test

    t = heterogeneity_test(spell(spark, sf), FIT_CLUSTER, FIT_HAZARD, ident="id")
    return t.frame(spark).select("b", r("stat", 4), "is_null").withColumn("p_value", F.lit(round(t.p_value, 6))).withColumn("n_not_converged", F.lit(t.n_not_converged))


@query("permutation_test_cv")
def q_perm_test(spark, sf):
    from mixhaz.plans.inference import heterogeneity_test

    t = heterogeneity_test(spell(spark, sf), FIT_CLUSTER, FIT_HAZARD, ident="id", statistic="cv", null="permutation")
    return t.frame(spark).select("b", r("stat", 4), "is_null").withColumn("p_value", F.lit(round(t.p_value, 6))).withColumn("n_not_converged", F.lit(t.n_not_converged))


@query("sequential_k")
def q_sequential(spark, sf):
    from mixhaz.plans.inference import sequential_k

    got = sequential_k(spell(spark, sf), FIT_CLUSTER, FIT_HAZARD, b=99, ident="id")
    return spark.createDataFrame([(n, p, got["k"], got["n_not_converged"][n]) for n, p in got["p_values"].items()],
                                 "test string, p_value double, k int, n_not_converged int")


@query("competitor_fit", _certificate_sql(FIT_HAZARD, gate=True))
def q_gated(spark, sf):
    from mixhaz.plans.gated import fit_gated

    return _certified(fit_gated(spell(spark, sf), FIT_CLUSTER, FIT_HAZARD, ident="id"))


# ---------------------------------------------------------------- further steps and roll-ups

_GATE = ((0.2, -0.2), {"z_price": (0.5, -0.5), "z_lines": (-0.3, 0.3), "z_disc": (0.1, -0.1)})


@query("gate_probabilities", f"""WITH {SCALED}, g AS (SELECT id, {_GATE[0][0]} + {' + '.join(f'({b[0]}) * {z}' for z, b in _GATE[1].items())} AS a,
 {_GATE[0][1]} + {' + '.join(f'({b[1]}) * {z}' for z, b in _GATE[1].items())} AS b FROM z)
SELECT id, round(1 / (1 + exp(b - a)), 6) AS p_1, round(1 / (1 + exp(a - b)), 6) AS p_2 FROM g""")
def q_gate(spark, sf):
    z = [F.col(c) for c in _GATE[1]]
    lin = [F.lit(_GATE[0][k]) + X.dot(z, [b[k] for b in _GATE[1].values()]) for k in range(2)]
    out = mixture.add_memberships(scaled(spark, sf), lin, prefix="p_")
    return out.select("id", r("p_1"), r("p_2"))


@query("profile_direction", f"""WITH {TAU}, h AS (SELECT *, CASE WHEN tau1 >= tau2 THEN 1 ELSE 2 END AS c FROM tau),
m AS (SELECT {", ".join(f"avg({z}) FILTER (c = 2) - avg({z}) FILTER (c = 1) AS {z}" for z in CLUSTER_FEATURES)} FROM h),
n AS (SELECT *, sqrt({" + ".join(f"{z} * {z}" for z in CLUSTER_FEATURES)}) AS norm FROM m) """ + " UNION ALL ".join(
    f"SELECT '{z}' AS feature, round({z} / norm, 6) AS direction FROM n" for z in CLUSTER_FEATURES))
def q_profile(spark, sf):
    m = memberships(spark, sf).withColumn("c", X.first_argmax([F.col("tau1"), F.col("tau2")]))
    return metrics.profile_direction(m, CLUSTER_FEATURES, "c").select("feature", r("direction"))


@query("events_per_coefficient", f"""WITH {TAU}, h AS (SELECT CASE WHEN tau1 >= tau2 THEN 1 ELSE 2 END AS c, sum(status) AS e, count(*) AS n FROM tau GROUP BY 1)
SELECT min(e)::BIGINT AS events_sub_min, round(min(e) / 4.0, 6) AS events_per_coef, round(sum(e)::DOUBLE / sum(n), 6) AS realized_rate FROM h""")
def q_epc(spark, sf):
    m = memberships(spark, sf).withColumn("c", X.first_argmax([F.col("tau1"), F.col("tau2")]))
    return metrics.events_per_coefficient(m, "c", 4).select("events_sub_min", r("events_per_coef"), r("realized_rate"))


@query("decision_rule", f"""WITH {_DIFFS}, g AS (SELECT comparator, count(*) AS cells, count_if(diff < -2 * diff_mcse)::BIGINT AS worse, avg(diff) AS m, 2 * sqrt(sum(diff_mcse * diff_mcse)) / count(*) AS margin FROM pd GROUP BY 1)
SELECT comparator, cells, worse, round(m, 6) AS mean_diff, round(margin, 6) AS margin, worse = 0 AND m >= -margin AS adopt FROM g""")
def q_rule(spark, sf):
    g = summaries.decision_rule(_diffs(spark, sf), ["comparator"])
    return g.select("comparator", "cells", "worse", r("mean_diff"), r("margin"), "adopt")


@query("row_pick", f"""WITH {WIDE}, l AS (SELECT cell, rep, [single, two_stage, features_only, joint] AS v FROM wide)
SELECT cell, rep, list_position(v, list_max(v))::INTEGER AS best, list_position(v, list_min(v))::INTEGER AS worst FROM l WHERE list_max(v) IS NOT NULL""")
def q_pick(spark, sf):
    w = summaries.wide(trial(spark, sf), ["cell"], METHODS)
    arr = F.array("single", "two_stage", "features_only", "joint")
    return w.where(F.array_max(arr).isNotNull()).select(
        "cell", "rep", F.array_position(arr, F.array_max(arr)).cast("int").alias("best"),
        F.array_position(arr, F.array_min(arr)).cast("int").alias("worst"))


@query("union_by_name", f"""WITH {TRIAL} SELECT cell, method, count(*) AS n, count(secs) AS timed FROM (
 SELECT cell, method, rep, secs FROM trial WHERE NOT failed UNION ALL SELECT cell, method, rep, NULL FROM trial WHERE failed) GROUP BY 1, 2""")
def q_union(spark, sf):
    """Usable and failed rows of all methods; failed ones come without a time."""
    t = trial(spark, sf)
    both = t.where(~F.col("failed")).select("cell", "method", "rep", "secs").unionByName(
        t.where("failed").select("cell", "method", "rep"), allowMissingColumns=True)
    return both.groupBy("cell", "method").agg(F.count("*").alias("n"), F.count("secs").alias("timed"))


# ---------------------------------------------------------------- verdicts and checks

def _mode_sql(mode: str) -> str:
    """Paired differences of one scoring, as CTEs with that suffix."""
    value = "CASE WHEN degenerate THEN sqrt(2 / (pi() * p)) ELSE recovery END" if mode == "floor" else "recovery"
    keep = "NOT failed" if mode == "floor" else "NOT failed AND NOT degenerate"
    pairs = " UNION ALL ".join(f"SELECT cell, '{c}' AS comparator, joint - {c} AS d FROM w_{mode}" for c in ("features_only", "two_stage", "single"))
    return (f"w_{mode} AS (SELECT cell, rep, " + ", ".join(f"max({value}) FILTER (method = '{m}') AS {m}" for m in METHODS)
            + f" FROM trial WHERE {keep} GROUP BY 1, 2), d_{mode} AS ({pairs}), p_{mode} AS (SELECT cell, comparator, '{mode}' AS scoring, avg(d) AS diff,"
            f" stddev_samp(d) / sqrt(count(d)) AS e FROM d_{mode} GROUP BY 1, 2)")


_SCORINGS = f"""{TRIAL}, {_mode_sql('exclude')}, {_mode_sql('floor')}, both_modes AS (SELECT * FROM p_exclude UNION ALL SELECT * FROM p_floor),
verdict AS (SELECT *, CASE WHEN diff IS NULL OR e IS NULL THEN NULL WHEN diff > 2 * e THEN 'beats' WHEN diff < -2 * e THEN 'loses' ELSE 'matches' END AS verdict FROM both_modes)"""


def _scorings(spark, sf):
    t = trial(spark, sf)
    out = None
    for mode in ("exclude", "floor"):
        w = summaries.wide(t, ["cell"], METHODS, mode=mode)
        d = summaries.paired_differences(w, ["cell"], "joint", ["features_only", "two_stage", "single"]).withColumn("scoring", F.lit(mode))
        out = d if out is None else out.unionByName(d)
    return out.withColumn("verdict", checks.cell_verdict())


@query("cell_verdicts", f"WITH {_SCORINGS} SELECT cell, comparator, scoring, round(diff, 6) AS diff, verdict FROM verdict")
def q_cell_verdicts(spark, sf):
    return _scorings(spark, sf).select("cell", "comparator", "scoring", r("diff"), "verdict")


@query("verdict_regimes", f"""WITH {_SCORINGS}, g AS (SELECT CASE WHEN regexp_matches(cell, '^[12]-') THEN 'urgent' WHEN cell = '3-MEDIUM' THEN 'medium' ELSE 'slow' END AS regime, verdict
  FROM verdict WHERE scoring = 'exclude')
SELECT regime, count(verdict) AS cells, CASE WHEN count(verdict) = 0 THEN NULL WHEN bool_or(verdict = 'beats') AND bool_or(verdict = 'loses') THEN 'mixed'
  WHEN bool_or(verdict = 'beats') THEN 'beats' WHEN bool_or(verdict = 'loses') THEN 'loses' ELSE 'matches' END AS verdict FROM g GROUP BY 1""")
def q_regimes(spark, sf):
    cells = _scorings(spark, sf).where("scoring = 'exclude'")
    regime = F.when(F.col("cell").rlike("^[12]-"), "urgent").when(F.col("cell") == "3-MEDIUM", "medium").otherwise("slow")
    return checks.regime_verdicts(cells, regime)


@query("verdict_pivot", f"""WITH {_SCORINGS} SELECT cell, comparator, """ + ", ".join(
    f"round(max({v}) FILTER (scoring = '{n}'), 6) AS {o}_{n}" for v, o in (("diff", "diff"), ("e", "diff_mcse")) for n in ("exclude", "floor")) + ", " + ", ".join(
    f"max(verdict) FILTER (scoring = '{n}') AS verdict_{n}" for n in ("exclude", "floor")) + " FROM verdict GROUP BY 1, 2 ORDER BY 1 DESC, 2")
def q_verdict_pivot(spark, sf):
    got = checks.spread_values(_scorings(spark, sf), ["cell", "comparator"], "scoring", ["exclude", "floor"], ["diff", "diff_mcse", "verdict"])
    return got.select("cell", "comparator", *[r(f"{v}_{n}") for v in ("diff", "diff_mcse") for n in ("exclude", "floor")],
                      "verdict_exclude", "verdict_floor").orderBy(F.desc("cell"), "comparator")


@query("manifest_left", f"""WITH {TRIAL}, m AS (SELECT l_orderkey AS rep, sum(l_quantity) AS total, any_value(o_orderpriority) AS cell FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE o_orderstatus <> 'P' GROUP BY 1), t AS (SELECT cell, rep, failed, sum(events) OVER (PARTITION BY cell, rep) - events * (CASE WHEN method = 'tight' THEN 1 ELSE 0 END) AS events FROM trial)
SELECT cell, rep, count(*) AS checked, bool_or(total IS NULL) AS missing, bool_or(total IS NULL OR NOT (failed OR events = total)) AS bad FROM t LEFT JOIN m USING (cell, rep) GROUP BY 1, 2""")
def q_manifest_left(spark, sf):
    """Rows of results against a manifest of event totals that lacks the partly shipped orders; rows of the seventh method carry a wrong total."""
    t = trial(spark, sf)
    all_of = t.groupBy("cell", "rep").agg(F.sum("events").alias("total_events"))
    rows = t.join(all_of, ["cell", "rep"]).withColumn("events", F.col("total_events") - F.when(F.col("method") == "tight", F.col("events")).otherwise(0))
    kept = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("rep"), F.col("o_orderpriority").alias("cell"))
    manifest = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("rep")).agg(F.sum("l_quantity").alias("total")).join(kept, "rep")
    return checks.checked_against(rows, manifest, ["cell", "rep"], {"events": "total"}, "failed")


@query("datasets_per_replicate", f"""WITH {TRIAL} SELECT cell, rep, count(DISTINCT CASE WHEN NOT failed THEN events END) AS datasets,
 count(DISTINCT CASE WHEN NOT failed THEN events END) <= 1 AS consistent FROM trial GROUP BY 1, 2""")
def q_datasets(spark, sf):
    return checks.one_dataset_each(trial(spark, sf), ["cell", "rep"], "events", "failed")


@query("two_tables_inner", f"""WITH {TRIAL}, j AS (SELECT a.cell, a.method, a.ari AS p_frozen, b.ari AS p_new FROM trial a JOIN trial b ON a.cell = b.cell AND a.rep = b.rep AND a.method = b.method
  WHERE NOT a.failed AND NOT b.degenerate AND NOT b.failed)
SELECT cell, method, count(*) AS datasets, round(avg((p_frozen <= 0.35)::INTEGER), 6) AS rejects_frozen, round(avg((p_new / 2 <= 0.35)::INTEGER), 6) AS rejects_new,
 round(avg(((p_frozen <= 0.35) = (p_new / 2 <= 0.35))::INTEGER), 6) AS agree FROM j GROUP BY 1, 2""")
def q_two_tables(spark, sf):
    """Decisions of one result table against those of a second one with halved values, on the same (cell, rep, method)."""
    t = trial(spark, sf)
    new = t.where("not degenerate").withColumn("ari", F.col("ari") / 2)
    got = checks.rejections_of_two(t, new, ["cell", "rep", "method"], ["cell", "method"], "ari", "failed", 0.35)
    return got.select("cell", "method", "datasets", r("rejects_frozen"), r("rejects_new"), r("agree"))


_SEPARATION = "CASE substr(cell, 1, 1) WHEN '1' THEN 0.5 WHEN '2' THEN 1.0 WHEN '3' THEN 2.0 WHEN '4' THEN 3.0 ELSE 4.0 END::DOUBLE"


@query("pilot_verdicts", f"""WITH {TRIAL}, s AS (SELECT {_SEPARATION} AS beta_sep, method, avg(recovery) AS recovery, avg(ari) AS ari FROM trial WHERE NOT failed GROUP BY 1, 2),
f AS (SELECT sqrt(2 / (pi() * 10)) AS fl), a AS (SELECT method, avg(recovery) - any_value(fl) AS above FROM s, f WHERE beta_sep >= 1 GROUP BY 1),
g AS (SELECT beta_sep, (max(recovery) FILTER (method = 'joint') - max(recovery) FILTER (method = 'features_only')) / (beta_sep * beta_sep) AS x FROM s WHERE beta_sep >= 1 GROUP BY 1),
o AS (SELECT (SELECT max(above) FROM a WHERE method IN ('single', 'two_stage', 'features_only')) AS b, (SELECT max(above) FROM a WHERE method = 'joint') AS i,
  (SELECT stddev_samp(x) / avg(x) FROM g) AS v, (SELECT max(ari) FROM s WHERE method = 'joint') AS ra, (SELECT max(recovery - fl) FROM s, f WHERE method = 'joint') AS re)
SELECT round(b, 6) AS blind_excess, round(i, 6) AS informed_excess, round(v, 4) AS variation, round(ra, 6) AS best_ari, round(re, 6) AS best_excess,
 b < 0.05 AND i > 0.05 AS p1, v IS NOT NULL AND v < 0.5 AS p2, ra < 0.10 AND re > 0.05 AS p3 FROM o""")
def q_pilot(spark, sf):
    first = F.substring("cell", 1, 1)
    sep = F.when(first == "1", 0.5).when(first == "2", 1.0).when(first == "3", 2.0).when(first == "4", 3.0).otherwise(4.0)
    means = trial(spark, sf).where("not failed").groupBy(sep.alias("beta_sep"), "method").agg(F.avg("recovery").alias("recovery"), F.avg("ari").alias("ari"))
    got = checks.pilot_verdicts(means, ["single", "two_stage", "features_only"], "joint", "features_only", F.lit(10))
    return got.select(r("blind_excess"), r("informed_excess"), r("variation", 4), r("best_ari"), r("best_excess"), "p1", "p2", "p3")


# ---------------------------------------------------------------- claims as data

#: id, measure, relation, bound; claims A to L of two arms of fits, each measured on the cells of the trial table
CLAIMS = [("A", "margin_over_features_only", ">", 0.0), ("B", "margin_over_two_stage", ">", 0.0), ("C", "margin_over_single", ">", 0.0),
          ("D", "blind_excess", "<", 0.05), ("D", "own_excess", ">", 0.05), ("E", "gain_variation", "<", 0.5), ("F", "largest_ari", "<", 0.10),
          ("F", "least_excess", ">", 0.05), ("G", "recovery_rise", ">", 0.0), ("H", "gain_rise", ">", 0.0), ("I", "gain_fall", "<", 0.0),
          ("J", "error_margin", ">=", 0.0), ("K", "size_margin", "<=", 0.0), ("L", "power", None, None)]
ARMS = {"frozen": "joint", "converged": "tight"}
_BLIND = ("features_only", "two_stage", "single")


def _claims_sql() -> str:
    kept = "trial WHERE NOT failed AND NOT degenerate"
    wide = ", ".join(f"max({{v}}) FILTER (method = '{m}') AS {m}" for m in METHODS)
    floor = "sqrt(2 / (pi() * 10))"
    parts, facts = [], []
    parts += [f"w_{v} AS (SELECT cell, rep, {wide.format(v=v)} FROM {kept} GROUP BY 1, 2)" for v in ("recovery", "mse_eta")]
    parts.append(f"me AS (SELECT method, cell, avg(recovery) AS rec, stddev_samp(recovery) / sqrt(count(recovery)) AS rec_e, avg(ari) AS ari FROM {kept} GROUP BY 1, 2)")
    for arm, m in ARMS.items():
        pairs = " UNION ALL ".join(f"SELECT cell, '{c}' AS c, {m} - {c} AS d FROM w_recovery" for c in _BLIND)
        parts.append(f"p_{arm} AS (SELECT cell, c, avg(d) AS diff, stddev_samp(d) / sqrt(count(d)) AS e, substr(cell, 1, 1)::DOUBLE AS x FROM ({pairs}) GROUP BY 1, 2)")
        parts.append(f"g_{arm} AS (SELECT arg_min(diff, cell) AS d0, arg_max(diff, cell) AS d1, arg_min(e, cell) AS e0, arg_max(e, cell) AS e1, "
                     f"stddev_samp(diff / (x * x)) / avg(diff / (x * x)) AS cv FROM p_{arm} WHERE c = 'features_only')")
        parts.append(f"r_{arm} AS (SELECT arg_max(rec, cell) - arg_min(rec, cell) - 2 * sqrt(arg_max(rec_e, cell) ** 2 + arg_min(rec_e, cell) ** 2) AS rise, max(ari) AS ari, "
                     f"min(rec) - {floor} AS least, avg(rec) - {floor} AS own FROM me WHERE method = '{m}')")
        fact = lambda name, value, source, arm=arm: f"SELECT '{arm}' AS arm, {name} AS measure, {value} AS value FROM {source}"
        facts += [fact("'margin_over_' || c", "diff - 2 * e", f"p_{arm}"),
                  fact("'blind_excess'", "max(a)", f"(SELECT avg(rec) - {floor} AS a FROM me WHERE method IN {_BLIND} GROUP BY method)"),
                  fact("'own_excess'", "own", f"r_{arm}"), fact("'gain_variation'", "cv", f"g_{arm}"), fact("'largest_ari'", "ari", f"r_{arm}"),
                  fact("'least_excess'", "least", f"r_{arm}"), fact("'recovery_rise'", "rise", f"r_{arm}"),
                  fact("'gain_rise'", "d1 - d0 - 2 * sqrt(e0 * e0 + e1 * e1)", f"g_{arm}"), fact("'gain_fall'", "d1 - d0 + 2 * sqrt(e0 * e0 + e1 * e1)", f"g_{arm}"),
                  fact("'error_margin'", "avg(d) + 2 * stddev_samp(d) / sqrt(count(d))", f"(SELECT cell, {m} - single AS d FROM w_mse_eta) GROUP BY cell"),
                  fact("'size_margin'", "avg((ari <= 0.05)::INTEGER) - 0.05 - 2 * sqrt(0.0475 / count(*))", f"{kept} AND method = '{m}' GROUP BY cell"),
                  fact("'power'", "avg((ari <= 0.05)::INTEGER)", f"{kept} AND method = '{m}' GROUP BY cell")]
    rules = ", ".join(f"('{i}', '{m}', {'NULL' if r_ is None else repr(r_)}, {'NULL' if b is None else b})" for i, m, r_, b in CLAIMS)
    return f"""WITH {TRIAL}, {', '.join(parts)}, facts AS ({' UNION ALL '.join(facts)}),
rules(id, measure, relation, bound) AS (VALUES {rules}),
j AS (SELECT id, arm, value, CASE relation WHEN '>' THEN value > bound WHEN '>=' THEN value >= bound WHEN '<' THEN value < bound WHEN '<=' THEN value <= bound END AS met
  FROM rules JOIN facts USING (measure))
SELECT id, arm, count(value) AS cells, count(*) FILTER (met) AS met, CASE WHEN count(*) FILTER (NOT met) > 0 THEN 'fails' WHEN count(*) FILTER (met) < count(*) THEN 'open' ELSE 'holds' END AS verdict
FROM j GROUP BY 1, 2"""


@query("claims", _claims_sql())
def q_claims(spark, sf):
    """Claims A to L for two arms: rules joined to what was measured on each cell, judged in three-valued logic."""
    t = trial(spark, sf)
    kept = t.where("not failed and not degenerate")
    floor = (2 / (math.pi * 10)) ** 0.5
    rec, err = (summaries.wide(t, ["cell"], METHODS, value=v) for v in ("recovery", "mse_eta"))
    means = kept.groupBy("method", "cell").agg(F.avg("recovery").alias("rec"), summaries.mcse("recovery").alias("rec_e"), F.avg("ari").alias("ari"))
    blind = means.where(F.col("method").isin(*_BLIND)).groupBy("method").agg((F.avg("rec") - floor).alias("a")).agg(F.max("a").alias("blind_excess"))

    def long(rows, arm, *names):
        return rows.select(F.lit(arm).alias("arm"), F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names)))).withColumnsRenamed({"key": "measure"})

    facts = None
    for arm, m in ARMS.items():
        d = summaries.paired_differences(rec, ["cell"], m, list(_BLIND))
        gain = d.where("comparator = 'features_only'")
        ends = [F.min_by(F.struct("diff", F.col("diff_mcse").alias("e")), "cell").alias("a"), F.max_by(F.struct("diff", F.col("diff_mcse").alias("e")), "cell").alias("z")]
        scaled = F.col("diff") / F.pow(F.substring("cell", 1, 1).cast("double"), F.lit(2.0))
        moved = gain.agg(*ends, (F.stddev_samp(scaled) / F.avg(scaled)).alias("gain_variation")).select(
            "gain_variation", (F.col("z.diff") - F.col("a.diff")).alias("by"), F.sqrt(F.col("a.e") ** 2 + F.col("z.e") ** 2).alias("se")).select(
            "gain_variation", (F.col("by") - 2 * F.col("se")).alias("gain_rise"), (F.col("by") + 2 * F.col("se")).alias("gain_fall"))
        own = means.where(F.col("method") == m)
        two = [F.min_by(F.struct("rec", "rec_e"), "cell").alias("a"), F.max_by(F.struct("rec", "rec_e"), "cell").alias("z")]
        levels = own.agg(*two, F.max("ari").alias("largest_ari"), (F.min("rec") - floor).alias("least_excess"), (F.avg("rec") - floor).alias("own_excess")).select(
            "largest_ari", "least_excess", "own_excess",
            (F.col("z.rec") - F.col("a.rec") - 2 * F.sqrt(F.col("a.rec_e") ** 2 + F.col("z.rec_e") ** 2)).alias("recovery_rise"))
        worse = summaries.paired_differences(err, ["cell"], m, ["single"]).select((F.col("diff") + 2 * F.col("diff_mcse")).alias("error_margin"))
        size = summaries.rejection_rates(kept.where(F.col("method") == m), ["cell"], "ari").select((F.col("rate") - F.col("upper")).alias("size_margin"), F.col("rate").alias("power"))
        parts = [d.select(F.lit(arm).alias("arm"), F.concat(F.lit("margin_over_"), "comparator").alias("measure"), (F.col("diff") - 2 * F.col("diff_mcse")).alias("value")),
                 long(blind, arm, "blind_excess"), long(moved, arm, *moved.columns), long(levels, arm, *levels.columns), long(worse, arm, "error_margin"),
                 long(size, arm, "size_margin", "power")]
        for part in parts:
            facts = part if facts is None else facts.unionByName(part)
    rules = spark.createDataFrame(CLAIMS, "id string, measure string, relation string, bound double")
    verdict = F.when(F.col("holds"), "holds").when(~F.col("holds"), "fails").otherwise("open")
    return checks.judged_claims(facts, rules, ["arm"]).select("id", "arm", "cells", "met", verdict.alias("verdict"))


@query("cell_manifest", f"""WITH {TRIAL} SELECT cell, count(*) AS rows, count(DISTINCT rep) AS reps, true AS read_back FROM trial GROUP BY 1""")
def q_manifest(spark, sf):
    """The trial rows through the two-phase sink, a cell replaced in a second commit: the manifest against what is read back."""
    import uuid

    from mixhaz.sources import cells
    from mixhaz.sources.durable import checkpoint_dir

    path = f"{checkpoint_dir(spark)}/cells-{uuid.uuid4().hex}"
    t = trial(spark, sf).select("cell", "rep", "method", "ari", "events", "failed")
    cells.write_cells(t, path)
    cells.write_cells(t.where("cell = '1-URGENT'"), path)
    kept = cells.read_results(spark, path)
    again = cells.fingerprints(kept).withColumnsRenamed({"rows": "r", "fingerprint": "f"})
    reps = kept.groupBy("cell").agg(F.count_distinct("rep").alias("reps"))
    same = (F.col("rows") == F.col("r")) & (F.col("fingerprint") == F.col("f"))
    return cells.manifest(spark, path).join(again, "cell").join(reps, "cell").select("cell", "rows", "reps", same.alias("read_back"))


# ---------------------------------------------------------------- methods compared on the groups of a table

_PARTS = "concat(CASE WHEN i_building = 1 THEN 'building' ELSE 'other' END, '-', (id % 4)::VARCHAR)"


@query("group_comparison", f"""WITH {SPELL}, g AS (SELECT {_PARTS} AS part, count(*) AS n, sum(status)::BIGINT AS events,
  least(count(*) FILTER (f_lines < 4), count(*) FILTER (f_lines >= 4)) AS small, least(sum(status) FILTER (f_lines < 4), sum(status) FILTER (f_lines >= 4))::BIGINT AS small_events FROM spell GROUP BY 1)
SELECT part, m AS method, n, events, CASE m WHEN 'labelled' THEN small WHEN 'single' THEN n END AS min_size, CASE m WHEN 'labelled' THEN small_events WHEN 'single' THEN events END AS min_events,
  CASE m WHEN 'labelled' THEN 1.0 END::DOUBLE AS ari, false AS failed
FROM g, (SELECT unnest(['single', 'two_stage', 'labelled', 'features_only', 'joint', 'gated', 'joint_temp2', 'joint_normalised']) AS m)""")
def q_groups(spark, sf):
    """Eight methods on eight parts of the spells, with few and many lines as given labels: counts at given labels are those of SQL."""
    from mixhaz.plans.comparison import compare_methods

    part = F.concat(F.when(F.col(INDICATOR) == 1, "building").otherwise("other"), F.lit("-"), (F.col("id") % 4).cast("string"))
    s = spell(spark, sf).withColumn("part", part).withColumn("few", (F.col("f_lines") >= 4).cast("int"))
    got = compare_methods(s, "part", FIT_CLUSTER, ["f_price", "f_bal", "f_qty"], label="few", by_passes=True, methods=(
        "single", "two_stage", "labelled", "features_only", "joint", "gated", "joint_temp2", "joint_normalised"))
    given = F.col("method").isin("single", "labelled")
    return got.select("part", "method", "n", "events", *[F.when(given, F.col(c)).alias(c) for c in ("min_size", "min_events")],
                      F.when(F.col("method") == "labelled", F.round("ari", 6)).alias("ari"), "failed")


_PRIOR = (len(CLUSTER_FEATURES) + 2, 2 ** (-2 / len(CLUSTER_FEATURES)))


@query("map_moment_step", f"WITH {TAU}, m AS (" + " UNION ALL ".join(
    f"SELECT {k} AS cluster, '{z}' AS feature, sum(tau{k}) AS w, sum(tau{k} * {z}) AS s, sum(tau{k} * {z} * {z}) AS q FROM tau" for k in (1, 2) for z in CLUSTER_FEATURES) + f""")
SELECT cluster, feature, round(s / (w + 0.01), 6) AS mean, round(({_PRIOR[1]!r} + q - s * s / w + 0.01 * w / (0.01 + w) * (s / w) * (s / w)) / ({_PRIOR[0]} + w + 3), 6) AS variance FROM m""")
def q_map(spark, sf):
    """One step of the mixture with a conjugate prior from fixed memberships."""
    from mixhaz.plans.engine import map_moments

    tau = ["tau1", "tau2"]
    sums = mixture.weighted_moments(memberships(spark, sf), CLUSTER_FEATURES, tau, ridge=0.0).collect()
    rows = []
    for s in sums:  # one row for each cluster and feature
        w, mean = s["weight_sum"], s["mean"]
        square = w * (s["variance"] + mean * mean)
        m, v = map_moments(w, np.array([w * mean] * len(CLUSTER_FEATURES)), np.array([square] * len(CLUSTER_FEATURES)), len(tau))
        rows.append((s["cluster"], s["feature"], round(float(m[0]), 6), round(float(v[0]), 6)))
    return spark.createDataFrame(rows, "cluster int, feature string, mean double, variance double")

"""Comparison of methods on the groups of a given table: one row for each group and method.

Every group (a trial site, a replicate, a period) is a data set of its own. Its rows meet in one task, which fits all methods there with the engine of
`tasks`; larger groups may go by passes, all of them and all methods together. Nothing of a group passes through the driver, and a group or method that fails gives a row that says so.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixhaz.functions.exprs import col, hash_uniform
from mixhaz.operators.scaling import InputError
from mixhaz.plans import kernels, tasks
from mixhaz.plans.engine import Engine, Fit, Job, weighting
from mixhaz.plans.fitting import ROW_ID, make_settings, with_row_id
from mixhaz.plans.grids import ClusterGrid, DriverGrid
from mixhaz.plans.panel import build_panel

#: what each method changes in the settings; single, two_stage and labelled end in plain proportional-hazards fits of hard groups
METHODS: dict[str, dict] = {
    "single": {}, "two_stage": {"gamma": 0.0, "conjugate": True}, "labelled": {}, "features_only": {"gamma": 0.0}, "joint": {}, "gated": {"prior": "gate"},
    "features_only_tight": {"gamma": 0.0, "tol": 1e-8, "max_iter": 1000}, "joint_tight": {"tol": 1e-8, "max_iter": 1000},
    "gated_tight": {"prior": "gate", "tol": 1e-8, "max_iter": 1000}, "joint_temp2": {"temp": 2.0}, "joint_normalised": {"normalize_gmm_by_dim": True}}
#: numbers of a group that one task may hold: its rows reach the task as a table
GROUP_CELLS = 2_000_000
FIELDS = [("method", pa.string()), ("n", pa.int64()), ("events", pa.int64()), ("failed", pa.bool_()), ("error", pa.string()), ("objective", pa.float64()),
          ("converged", pa.bool_()), ("iterations", pa.int64()), ("sharpness", pa.float64()), ("ari", pa.float64()), ("min_size", pa.int64()),
          ("min_events", pa.int64()), ("degenerate", pa.bool_()), ("n_zero_fits", pa.int64()), ("guard_bound", pa.bool_()), ("beta", pa.list_(pa.float64()))]
_DDL = ("method string, n long, events long, failed boolean, error string, objective double, converged boolean, iterations long, sharpness double, ari double, "
        "min_size long, min_events long, degenerate boolean, n_zero_fits long, guard_bound boolean, beta array<double>")


def rand_index(counts: np.ndarray) -> float:
    """Adjusted Rand index of a contingency table; 1 where both sides are one group."""
    pairs = lambda a: float((a * (a - 1) / 2).sum())
    both, rows, columns, n = pairs(counts), pairs(counts.sum(axis=1)), pairs(counts.sum(axis=0)), counts.sum()
    expected, top = rows * columns / max(n * (n - 1) / 2, 1), (rows + columns) / 2
    return 1.0 if top == expected else (both - expected) / (top - expected)


def _fit_group(x, u, time, status, label, names, roles, base, methods) -> list[dict]:
    n = len(time)
    fold = np.zeros(n, np.int32)
    data = tasks.Features(np.arange(n), u, x, names, None if label is None else label[:, None], fold)
    data, time, status = tasks.in_runs(data, time, status, roles)
    times, view = tasks.local_view(data, 0, time, status, fold)
    panel = tasks.LocalPanel(names, *roles, data.x, status, fold, times)
    labels = 0 if label is None else int(label.max()) + 1
    return _rows_of(lambda: tasks.LocalEngine(panel, view), panel, n, int(status.sum()), labels, base, methods)


#: methods that end in plain proportional-hazards fits of hard groups, and those of them that need no mixture before
PLAIN, GIVEN = ("single", "two_stage", "labelled"), ("single", "labelled")


def _empty_row(method: str, n: int, events: int) -> dict:
    return {name: None for name, _ in FIELDS} | {"method": method, "n": n, "events": events, "failed": True}


def _given_fit(number: int, method: str, labels: int, base, panel, rep: int) -> Fit:
    """A fit of hard groups that are known: all rows, or the given labels."""
    if method == "labelled" and not labels:
        raise InputError("no labels are given")
    k = 1 if method == "single" else labels
    return Fit(number, Job(replace(base, **METHODS[method], k=k, gamma=0.0), rep=rep, label=0 if method == "labelled" else None), panel)


def _filled(method: str, f: Fit, sums, labels: int) -> dict:
    """What a usable fit adds to its row."""
    beta = f.beta / f.cs[:, None]
    size, dead, given = sums[:f.k], sums[f.k:2 * f.k], sums[2 * f.k:].reshape(f.k, labels)
    fitted = bool(f.trace)
    return {"failed": False, "objective": float(f.final_score) if fitted else None, "converged": bool(f.converged) if fitted else None,
            "iterations": len(f.trace) if fitted else None, "sharpness": float(f.sharpness) if fitted else None,
            "ari": None if not labels or method == "single" else float(rand_index(given)),
            "min_size": int(size.min()), "min_events": int(dead.min()), "degenerate": bool(size.min() < 10 or dead.min() < 5),
            "n_zero_fits": int((~beta.any(axis=0)).sum()) if method in PLAIN else 0, "guard_bound": bool(f.guards), "beta": beta.T.ravel().tolist()}


def _rows_of(engine_of, panel, n: int, events: int, labels: int, base, methods, rep: int = 0) -> list[dict]:
    """A row for each method; `labels` is the number of given labels, 0 without any."""
    rows = []
    for method in methods:
        row = _empty_row(method, n, events)
        rows.append(row)
        try:
            engine = engine_of()
            if method in GIVEN:
                f = _given_fit(0, method, labels, base, panel, rep)
                engine.grid = (DriverGrid if engine.cells(f) <= engine.driver_cells else ClusterGrid)(panel)
            else:
                f = engine.run([Job(replace(base, **METHODS[method]), rep=rep)])[0]
                if f.error is None:
                    f.freeze(pi_min=1e-12)
                    f.mode = "hard"
            if f.error is None and method in PLAIN:
                engine.plain_cox([f])
            if f.error is not None:
                row["error"] = f.error
                continue
            with np.errstate(all="ignore"):
                sums = engine.sweep([f], kernels.group_counts(labels), grids=weighting([f]))[0][f.id]
            row |= _filled(method, f, sums, labels)
        except Exception as e:  # noqa: BLE001  a failed method is a row of the result
            row["error"] = f"{type(e).__name__}: {e}"[:200]
    return rows


def _rows_together(engine: Engine, panel, labels: dict[int, int], base, methods) -> dict[int, list[dict]]:
    """The rows of every group of a panel: the fits of all groups and methods share their passes."""
    rows = {r: [_empty_row(m, *panel.size(r, None)) for m in methods] for r in panel.reps}
    place = [(r, i, m) for r in panel.reps for i, m in enumerate(methods)]
    mixed = [p for p in place if p[2] not in GIVEN]
    fits = engine.run([Job(replace(base, **METHODS[m]), rep=r) for r, _, m in mixed])
    done = list(zip(mixed, fits))
    for p in place:
        if p[2] in GIVEN:
            try:
                done.append((p, _given_fit(engine.numbered, p[2], labels[p[0]], base, panel, p[0])))
                engine.numbered += 1
            except InputError as e:
                rows[p[0]][p[1]]["error"] = f"{type(e).__name__}: {e}"[:200]
    for (r, i, m), f in done:
        rows[r][i]["error"] = f.error
        if f.error is None and m not in GIVEN:
            f.freeze(pi_min=1e-12)
            f.mode = "hard"
    for batch in engine.batches([f for (_, _, m), f in done if m in PLAIN and f.error is None]):
        engine.plain_cox(batch)
    usable = [(p, f) for p, f in done if f.error is None]
    for count in sorted(set(labels.values())):
        mine = [(p, f) for p, f in usable if labels[p[0]] == count]
        if mine:
            with np.errstate(all="ignore"):
                sums = engine.sweep([f for _, f in mine], kernels.group_counts(count), grids=weighting([f for _, f in mine]))[0]
            for (r, i, m), f in mine:
                rows[r][i] |= _filled(m, f, sums[f.id], count)
    return rows


def _by_passes(df: DataFrame, roles, time: str, status: str, ident: str, label: str | None, base, methods) -> dict[int, list[dict]]:
    """The rows of groups (numbered in `_rep`) that are too large for a task: their table stays on the executors, the fits go by passes over it.

    Fits that share passes also share an exception: each group and method is then fitted alone.
    """
    names = list(dict.fromkeys([*roles[0], *roles[1]]))
    given = [label] if label else []
    panel = build_panel(with_row_id(df, [*names, time, status, *given, "_rep"], ident), *roles, time, status, ROW_ID, rep="_rep", labels=given)
    try:
        top = {r["rep"]: r["top"] for r in panel.data.groupBy("rep").agg(F.max(F.col("label")[0]).alias("top")).collect()} if label else {}
        labels = {r: top[r] + 1 if label else 0 for r in panel.reps}
        engine = Engine(panel)
        on_driver = all(m < engine.driver_cells // ((2 + len(panel.ci)) * (base.k + 1)) for m in panel.grid_size.values())
        if on_driver:
            try:
                return _rows_together(engine, panel, labels, base, methods)
            except Exception:  # noqa: BLE001  one of many: found by fitting each alone
                pass
        return {r: _rows_of(lambda: Engine(panel), panel, *panel.size(r, None), labels[r], base, methods, r) for r in panel.reps}
    finally:
        panel.release()


def compare_methods(df: DataFrame, group: str, cluster_vars: Sequence[str], hazard_vars: Sequence[str] | None = None, time: str = "time",
                    status: str = "status", ident: str = "id", label: str | None = None, methods: Sequence[str] = ("single", "two_stage", "features_only", "joint", "gated"),
                    k: int = 2, task_cells: int | None = None, by_passes: bool = False, **options) -> DataFrame:
    """One row per (group, method): sizes, objective, convergence, adjusted Rand index against `label` (0, 1, ...; optional), smallest cluster, beta (cluster by
    cluster, per unit of the feature).

    Groups of more than `task_cells` numbers are not for one task: with `by_passes` they are fitted together by passes over the cluster, else
    their rows say so. Rows with a null group form a group.
    """
    unknown = [m for m in methods if m not in METHODS]
    if unknown:
        raise InputError(f"unknown method(s): {', '.join(unknown)}")
    hazard_vars = list(cluster_vars if hazard_vars is None else hazard_vars)
    names = list(dict.fromkeys([*cluster_vars, *hazard_vars]))
    base, roles = make_settings(k, **options), (list(cluster_vars), hazard_vars)
    limit = (GROUP_CELLS if task_cells is None else task_cells) // (len(names) + 5)
    rows = df.select(col(group).alias("_group"), hash_uniform("start", ident).alias("_u"), col(ident).cast("string").alias("_id"), col(time).cast("double").alias("_time"),
                     col(status).cast("int").alias("_status"), F.array(*[col(n).cast("double") for n in names]).alias("_x"),
                     (col(label) if label else F.lit(0)).cast("int").alias("_label"))
    sizes = rows.groupBy("_group").agg(F.count("*").alias("n"), F.sum("_status").cast("long").alias("events"))
    large = sizes.where(F.col("n") > limit)
    fits = rows.join(large.select(F.col("_group").alias("_large")), F.col("_group").eqNullSafe(F.col("_large")), "left_anti")
    sent = cloudpickle.dumps((names, roles, base, list(methods), label is not None))

    def run(table: pa.Table) -> pa.Table:
        names, roles, base, methods, labelled = cloudpickle.loads(sent)
        table = table.combine_chunks().sort_by("_id")
        value = lambda c: table[c].to_numpy()
        got = _fit_group(kernels.matrix(table["_x"].combine_chunks()), value("_u"), value("_time"), value("_status"), value("_label") if labelled else None,
                         names, roles, base, methods)
        key = table["_group"].take(pa.array([0] * len(got)))
        return pa.table([key, *[pa.array([g[n] for g in got], t) for n, t in FIELDS]], names=["_group", *[n for n, _ in FIELDS]])

    kind = rows.schema["_group"].dataType.simpleString()
    done = fits.groupBy("_group").applyInArrow(run, f"_group {kind}, {_DDL}")
    if by_passes:
        # at most one group for each `limit` rows of the table
        keys = [g for g, in large.select("_group").collect()]
        more = []
        if keys:
            number = F.coalesce(*[F.when(col(group).eqNullSafe(F.lit(g)), F.lit(i)) for i, g in enumerate(keys)])
            found = _by_passes(df.withColumn("_rep", number).where("_rep is not null"), roles, time, status, ident, label, base, methods)
            more = [(g, *(f[name] for name, _ in FIELDS)) for i, g in enumerate(keys) for f in found[i]]
        return done.unionByName(df.sparkSession.createDataFrame(more, done.schema)).withColumnRenamed("_group", group) if more else done.withColumnRenamed("_group", group)
    told = large.select("_group", F.explode(F.array(*map(F.lit, methods))).alias("method"), "n", "events", F.lit(True).alias("failed"),
                        F.lit(f"more than {limit} rows: not for one task").alias("error"))
    return done.unionByName(told, allowMissingColumns=True).withColumnRenamed("_group", group)

"""As-of lookups: the grid row at or before (or at or after) every query value.

The grid becomes an index. While it is small it is sent to every task and searched there, so query rows are not shuffled. A longer grid is cut into
leaves of consecutive rows; the leaves' first values are searched in the same way, and each query row meets its leaf in one equality join, which Spark
splits where many rows ask for one leaf. Only grids with more groups than an index may hold go by pieces and distinct values.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixhaz.functions.exprs import col
from mixhaz.operators.prefix import PIECE, cut, running_totals, with_piece

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: grid rows that are sent to every task at most
INDEX_ROWS = 200_000
#: grid rows of a leaf at least
LEAF = 64


class Index:
    """A sorted grid for each key, searched by whole columns."""

    def __init__(self, table: pd.DataFrame, keys: list[str], forward: bool):
        """table: keys, _at, and the place that a hit stands for, ascending in _at."""
        self.keys, self.forward = keys, forward
        if keys:
            self.of = {k if isinstance(k, tuple) else (k,): (g["_at"].to_numpy(float), g["_place"].to_numpy()) for k, g in table.groupby(keys, dropna=False)}
        else:
            self.of = {(): (table["_at"].to_numpy(float), table["_place"].to_numpy())}

    def _find(self, key: tuple, asked: np.ndarray) -> np.ndarray:
        """Places, -1 where nothing matches. A missing value asks for nothing."""
        at, place = self.of.get(key, (np.empty(0), np.empty(0, np.int64)))
        found = np.searchsorted(at, asked, side="left") if self.forward else np.searchsorted(at, asked, side="right") - 1
        out = np.full(len(asked), -1, np.int64)
        ok = (found >= 0) & (found < len(at)) & ~np.isnan(asked)
        out[ok] = place[found[ok]]
        return out

    def search(self, asked: pd.Series, keys: list[pd.Series]) -> np.ndarray:
        values = asked.to_numpy(float)
        if not keys:
            return self._find((), values)
        out = np.full(len(values), -1, np.int64)
        for key, rows in pd.DataFrame(dict(enumerate(keys))).groupby(list(range(len(keys))), dropna=False).indices.items():
            out[rows] = self._find(key if isinstance(key, tuple) else (key,), values[rows])
        return out


def _searched(queries: DataFrame, on: str, table: pd.DataFrame, keys: Sequence[str], forward: bool, held: dict | None, name: str) -> DataFrame:
    """`queries` with `name`: the place found by the index (null: none), or what is held for that place."""
    keys = list(keys)
    sent = queries.sparkSession.sparkContext.broadcast(cloudpickle.dumps((Index(table, keys, forward), held and held["columns"])))
    kind = held["type"] if held else T.LongType()

    def find(asked: pd.Series, *by: pd.Series):
        index, columns = cloudpickle.loads(sent.value)
        place = index.search(asked, list(by))
        ok = place >= 0
        if columns is None:
            return pd.Series(place, dtype="Int64").where(ok)
        taken = {n: pd.Series(c[np.maximum(place, 0)] if len(c) else np.full(len(place), None), dtype=object).where(ok, None) for n, c in columns.items()}
        return pd.DataFrame(taken)

    find.__annotations__ = {"asked": pd.Series, "by": pd.Series, "return": pd.DataFrame if held else pd.Series}  # types, not their names
    udf = F.pandas_udf(find, kind)
    return queries.withColumn(name, udf(F.col(on).cast("double"), *[col(k) for k in keys]))


def asof(
    queries: DataFrame,
    grid: DataFrame,
    on: str,
    values: Sequence[str],
    grid_on: str | None = None,
    keys: Sequence[str] = (),
    direction: str = "backward",
) -> DataFrame:
    """Left as-of join of `queries` with `grid`; `values` are null where nothing matches.

    Grid rows are unique on (keys, grid_on) and not null there. A null or missing query value matches nothing.
    """
    forward = direction == "forward"
    grid_on = grid_on or on
    rows = grid.select(*keys, F.col(grid_on).cast("double").alias("_at"), F.struct(*[F.col(v) for v in values]).alias("_held")).persist()
    n = rows.count()
    if n <= INDEX_ROWS:
        out = _by_index(queries, rows, on, values, keys, forward)
        rows.unpersist()
        return out
    size = max(LEAF, -(-n // INDEX_ROWS))
    if keys and rows.select(*keys).distinct().count() * 2 > INDEX_ROWS:
        return _by_pieces(queries, rows, on, values, keys, forward)
    return _by_leaves(queries, rows, on, values, keys, forward, size)


def _by_index(queries, rows, on, values, keys, forward):
    """The whole grid in every task."""
    table = rows.select(*keys, "_at", *[F.col("_held").getField(v).alias(f"_v{i}") for i, v in enumerate(values)]).toPandas().sort_values("_at", kind="stable")
    table["_place"] = np.arange(len(table))
    kind = T.StructType([T.StructField(f"_v{i}", rows.schema["_held"].dataType[v].dataType) for i, v in enumerate(values)])
    held = {"type": kind, "columns": {f"_v{i}": table[f"_v{i}"].to_numpy() for i in range(len(values))}}
    out = _searched(queries, on, table, keys, forward, held, "_hit")
    return out.select(*[col(c) for c in queries.columns], *[F.col("_hit").getField(f"_v{i}").alias(v) for i, v in enumerate(values)])


def _by_leaves(queries, rows, on, values, keys, forward, size):
    """The leaves' edges in every task, the leaves by a join. A leaf holds `size` consecutive rows of a key."""
    placed = running_totals(cut(rows, "_at"), ["_at"], {"_pos": F.lit(1)}, keys).drop(PIECE)
    leaf = F.floor((F.col("_pos") - 1) / size).cast("long")
    leaves = placed.withColumn("_leaf", leaf).groupBy(*keys, "_leaf").agg(
        F.sort_array(F.collect_list(F.struct("_at", "_held"))).alias("_rows"), F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    edge = F.col("_high" if forward else "_low")
    table = leaves.select(*keys, edge.alias("_at"), F.col("_leaf").alias("_place")).toPandas().sort_values("_at", kind="stable")  # INDEX_ROWS and one a key
    asked = _searched(queries, on, table, keys, forward, None, "_asked")
    names = [f"_k{i}" for i in range(len(keys))]
    right = leaves.select("_rows", "_leaf", *[col(k).alias(n) for k, n in zip(keys, names)])
    match = F.col("_asked") == F.col("_leaf")
    for k, n in zip(keys, names):
        match = match & col(k).eqNullSafe(F.col(n))
    joined = asked.join(right, match, "left")
    q = F.col(on).cast("double")
    near = F.filter("_rows", (lambda r: r["_at"] >= q) if forward else (lambda r: r["_at"] <= q))
    hit = F.get(near, F.lit(0)) if forward else F.get(near, F.size(near) - 1)
    return joined.withColumn("_hit", hit).select(*[col(c) for c in queries.columns], *[F.col("_hit").getField("_held").getField(v).alias(v) for v in values])


def _by_pieces(queries, grid_rows, on, values, keys, forward):
    """Many groups: only the distinct query values meet the grid, so a value shared by many rows costs one lookup. The ordering is cut into
    pieces; the last grid row of the earlier pieces is carried into each piece, so no task sees the whole order."""
    ask = queries.select(*keys, F.col(on).cast("double").alias("_at")).distinct()
    ask = ask.select("*", F.lit(None).cast(grid_rows.schema["_held"].dataType).alias("_held"))
    both = grid_rows.withColumn("_asks", F.lit(0)).unionByName(ask.withColumn("_asks", F.lit(1)))
    both = with_piece(both, "_at", grid_rows)

    group = [*keys, PIECE]
    # a grid row comes before the query at the same value, in either direction
    order = [F.col("_at").desc() if forward else F.col("_at").asc(), F.col("_asks").asc()]
    inside = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_hit", F.last("_held", ignorenulls=True).over(inside)).where("_asks = 1")

    pick = F.min_by if forward else F.max_by
    edge = with_piece(grid_rows, "_at", grid_rows).groupBy(*group).agg(pick("_held", "_at").alias("_edge"))
    piece_dir = F.col(PIECE).desc() if forward else F.col(PIECE).asc()
    earlier = W.partitionBy(*(keys or [F.lit(0)])).orderBy(piece_dir).rowsBetween(W.unboundedPreceding, -1)
    # a piece without grid rows still needs its carry, so the pieces of the queries join in
    spots = found.select(*group).distinct().withColumn("_edge", F.lit(None).cast(edge.schema["_edge"].dataType))
    edges = edge.unionByName(spots).groupBy(*group).agg(F.first("_edge", ignorenulls=True).alias("_edge"))
    carry = edges.select(*group, F.last("_edge", ignorenulls=True).over(earlier).alias("_carry"))

    hits = found.join(carry, group).select(
        *keys, "_at", F.coalesce("_hit", "_carry").alias("_hit")
    )
    out = queries.withColumn("_at", F.col(on).cast("double")).join(hits, [*keys, "_at"], "left")
    return out.select(*[col(c) for c in queries.columns], *[F.col("_hit").getField(v).alias(v) for v in values])

"""Running sums and ranks that never sort a whole table (or a hot key) in one task.

The ordering column is cut into pieces by approximate quantiles, each piece is
summed on its own, and the few piece totals are turned into offsets. A key that
holds a large share of the rows is spread over many pieces by the same cut.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mixhaz.functions.exprs import col, hash_uniform

PIECE = "_piece"
SMALL_TABLE = 100_000


def piece_count(df: DataFrame) -> int:
    """As many pieces as shuffle partitions, within what a boundary array should hold."""
    return max(2, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2000))


def cut(df: DataFrame, order: str, source: DataFrame | None = None) -> DataFrame:
    """Add `_piece`, a non-decreasing function of `order` with about equal row counts.

    `source` (default: `df`) is a persisted table with the same spread of `order`. It
    is counted first: below SMALL_TABLE rows one task can order everything, no pieces
    are needed and `df` comes back unchanged. Otherwise the boundaries are one
    aggregate of `source`, read by the plan as a scalar subquery.
    """
    src = df if source is None else source
    if src.count() <= SMALL_TABLE:
        return df
    return with_piece(df, order, src)


def with_piece(df: DataFrame, order: str, source: DataFrame) -> DataFrame:
    n = piece_count(df)
    fractions = F.array(*[F.lit(i / n) for i in range(1, n)])
    bounds = source.agg(
        F.percentile_approx(F.col(order).cast("double"), fractions, F.lit(10_000)).alias("b")
    ).scalar()
    x = F.col(order).cast("double")
    held = df.withColumn("_bounds", bounds)
    below = F.size(F.filter("_bounds", lambda b: b < x))
    return held.withColumn(PIECE, F.coalesce(below, F.lit(0))).drop("_bounds")


def cut_uniform(df: DataFrame, u: str) -> DataFrame:
    """Pieces for a column that is uniform on (0, 1): no boundary pass is needed."""
    pieces = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.withColumn(PIECE, F.floor(F.col(u) * F.lit(pieces)).cast("int"))


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    totals: Mapping[str, Column | str],
    keys: Sequence[str] = (),
    descending: bool = False,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add inclusive running sums along `order` within `keys`.

    `df` comes from `cut`: with `_piece`, or without it if it is known to be small.
    Rows are unique on (keys, order), i.e. ties were aggregated first. `_piece` is
    kept, so further running sums over the same cut need no new shuffle of the rows.
    `source` has the same rows by a shorter plan (default: `df`): totals of the pieces come from there.
    """
    exprs = {out: (F.col(c) if isinstance(c, str) else c) for out, c in totals.items()}
    direction = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    if PIECE not in df.columns:
        whole = W.partitionBy(*(keys or [F.lit(0)])).orderBy(*direction).rowsBetween(W.unboundedPreceding, 0)
        return df.select("*", *[F.sum(e).over(whole).alias(o) for o, e in exprs.items()])
    group = [*keys, PIECE]
    inside = W.partitionBy(*group).orderBy(*direction).rowsBetween(W.unboundedPreceding, 0)
    local = df.select("*", *[F.sum(e).over(inside).alias(f"_in_{o}") for o, e in exprs.items()])

    piece_dir = F.col(PIECE).desc() if descending else F.col(PIECE).asc()
    outer = W.partitionBy(*(keys or [F.lit(0)])).orderBy(piece_dir)
    before = outer.rowsBetween(W.unboundedPreceding, -1)
    offsets = (df if source is None else source).groupBy(*group).agg(*[F.sum(e).alias(f"_sum_{o}") for o, e in exprs.items()]).select(
        *group, *[F.coalesce(F.sum(f"_sum_{o}").over(before), F.lit(0)).alias(f"_off_{o}") for o in exprs]
    )
    out = local.join(offsets, group)
    return out.select(
        *[col(c) for c in df.columns], *[(F.col(f"_in_{o}") + F.col(f"_off_{o}")).alias(o) for o in exprs]
    )


def hash_rank(df: DataFrame, seed, ident: str, keys: Sequence[str] = (), out: str = "pos",
              hashed: Sequence[str] | None = None, source: DataFrame | None = None) -> DataFrame:
    """1-based rank of every row in hashed order within `keys`: a reproducible shuffle.

    `hashed` names the columns that enter the hash (default: the identifier alone). `source`: see `running_totals`.
    """
    def drawn(rows):
        return cut_uniform(rows.withColumn("_u", hash_uniform(seed, *(hashed or [ident]))), "_u")

    ranked = running_totals(drawn(df), ["_u", ident], {out: F.lit(1)}, keys, source=None if source is None else drawn(source))
    return ranked.drop("_u", PIECE)


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """One row for each distinct `value`: its rank with ties averaged."""
    counts = df.groupBy(value).agg(F.count("*").alias("_n")).persist()
    upto = running_totals(cut(counts, value), [value], {"_cum": "_n"})
    return upto.select(value, (F.col("_cum") - (F.col("_n") - 1) / 2).alias(out))


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact interpolated quantiles per group, without holding a group in memory."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n")).persist()
    cum = running_totals(cut(counts, value), [value], {"_cum": "_n"}, keys).drop(PIECE)
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    both = cum.join(sizes, list(keys)) if keys else cum.withColumn("_total", sizes.select("_total").scalar())
    picks = []
    for name, p in probs.items():
        h = (F.col("_total") - 1) * F.lit(float(p))
        picks += [
            F.min(F.when(F.col("_cum") > F.floor(h), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_cum") > F.ceil(h), F.col(value))).alias(f"_hi_{name}"),
            F.max(h - F.floor(h)).alias(f"_fr_{name}"),
        ]
    got = both.groupBy(*keys).agg(*picks)
    return got.select(*keys, *[
        (F.col(f"_lo_{n}") + F.col(f"_fr_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n in probs
    ])

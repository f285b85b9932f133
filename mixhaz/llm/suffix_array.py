"""Suffix order of many strings of 64-bit symbols by difference-cover sampling (positions 1 and 2 modulo 3).

Triples at the sampled positions are sorted and named; while names repeat, the strings of names are ranked by the same
function. The remaining suffixes are sorted by (symbol, rank of the next suffix) and merged with the sampled ones. Every
sort is a range partitioning, every name an order-preserving number of a distinct triple, so equal triples meet in partial sums first.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import cut, forget

_BITS = 33  # of the row number within a partition in monotonically_increasing_id


def in_order(df: DataFrame, order: list[Column | str], name: str, paths: list[str] | None = None) -> DataFrame:
    """`df` with a number that ascends with `order`, not without gaps."""
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), paths)


def _listed(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few rows of longs as a table to send to every task. Handed over in Arrow: from a list of tuples, Spark starts Python processes
    of their own on each executor, which stay there."""
    columns = zip(*rows) if rows else [[] for _ in names]
    return F.broadcast(spark.createDataFrame(pa.table([pa.array(x, pa.int64()) for x in columns], names=names)))


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """`df` with its row number in `order`, from 0. Only one count for each partition comes to the driver."""
    rows = in_order(df, order, "_id")
    part = F.shiftrightunsigned("_id", _BITS)
    sizes = sorted((r[0], r[1]) for r in rows.groupBy(part.alias("p")).count().collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    table = _listed(df.sparkSession, offsets, ["_p", "_before"])  # one row for each partition
    return (rows.join(table, part == F.col("_p")).withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << _BITS) - 1))
            .drop("_id", "_p", "_before"))


def _last_before(df: DataFrame, order: list[Column | str], paths: list[str]) -> DataFrame:
    """Adds `pred`, the greatest `r` of the rows before in `order`, and `place`, a number that ascends with it. `r` ascends, too."""
    rows = in_order(df, order, "place", paths).withColumn("_p", F.shiftrightunsigned("place", _BITS))
    best, carried = None, []
    for p, top in sorted((x[0], x[1]) for x in rows.groupBy("_p").agg(F.max("r")).collect()):  # a row for each partition
        carried.append((p, best))
        best = top if best is None else best if top is None else max(best, top)
    table = _listed(df.sparkSession, carried, ["_q", "_carry"])
    here = Window.partitionBy("_p").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("_seen", F.max("r").over(here)).join(table, F.col("_p") == F.col("_q"))
            .withColumn("pred", F.coalesce("_seen", "_carry")).drop("_p", "_q", "_seen", "_carry"))


def _ranks(symbols: DataFrame, prefix: int | None) -> DataFrame:
    """(sid, sub, i, r): order-preserving numbers of all suffixes of the strings (sid, sub) of symbols x at i = 0, 1, ..."""
    string = Window.partitionBy("sid", "sub").orderBy("i")
    paths: list[str] = []
    cells = cut(symbols.select("sid", "sub", "i", "x", F.lead("x", 1).over(string).alias("x1"), F.lead("x", 2).over(string).alias("x2")), paths)
    sample = cells.filter("i % 3 > 0")
    end = F.when(F.col("x2").isNull(), F.col("sid"))  # an end is smaller than any symbol, and ends are told apart by their string
    end_sub = F.when(F.col("x2").isNull(), F.col("sub"))
    triple = ["x", "x1", "x2", "e", "f"]
    sample = sample.withColumns({"e": end, "f": end_sub})
    names = in_order(sample.groupBy(*triple).agg(F.count("*").alias("times")), triple, "name", paths)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in triple]
    keys = [f"_{c}" for c in triple]
    named = sample.join(names.withColumnsRenamed({c: f"_{c}" for c in triple}), same[0] & same[1] & same[2] & same[3] & same[4]).drop(*keys)
    if (prefix is not None and prefix <= 3) or names.filter("times > 1").isEmpty():
        ranked = named.select("sid", "sub", "i", F.col("name").alias("r"))
    else:
        side = F.col("i") % 3 - 1
        inner = _ranks(named.select("sid", (F.col("sub") * 2 + side).alias("sub"), F.expr("int(i div 3)").alias("i"), F.col("name").alias("x")),
                       None if prefix is None else (prefix + 2) // 3)
        ranked = inner.select("sid", F.expr("sub div 2").alias("sub"), (F.col("i") * 3 + 1 + F.col("sub") % 2).cast("int").alias("i"), "r")
    known = cells.join(ranked, ["sid", "sub", "i"], "left")
    known = cut(known.select("*", F.lead("r", 1).over(string).alias("r1"), F.lead("r", 2).over(string).alias("r2")), paths)
    # against position 1 a rest is compared by (symbol, next rank), against position 2 by (two symbols, rank after them)
    one = _last_before(known.filter("i % 3 < 2").select("sid", "sub", "i", "x", "r1", "r"), ["x", "r1", "sid", "sub"], paths)
    two = _last_before(known.filter("i % 3 <> 1").select("sid", "sub", "i", "x", "x1", "r2", "r"), ["x", "x1", "r2", "sid", "sub"], paths)
    rest = (one.filter("i % 3 = 0").select("sid", "sub", "i", "place", F.col("pred").alias("p1"))
            .join(two.filter("i % 3 = 0").select("sid", "sub", "i", F.col("pred").alias("p2")), ["sid", "sub", "i"])
            .select("sid", "sub", "i", F.greatest("p1", "p2").alias("r"), "place"))
    both = known.filter("i % 3 > 0").select("sid", "sub", "i", "r", F.lit(None).cast("long").alias("place")).unionByName(rest)
    done = in_order(both, ["r", F.col("place").asc_nulls_first()], "r2").select("sid", "sub", "i", F.col("r2").alias("r"))
    forget(symbols.sparkSession, paths)
    return done


def suffix_ranks(symbols: DataFrame, prefix: int | None = None) -> DataFrame:
    """(sid, i, rank) of every suffix of the strings `sid` (long) of symbols `x` (long) at i = 0, 1, ... (int): ranks 0, 1, ...

    Suffixes are compared symbol by symbol; the end of a string is smaller than any symbol, and ends are ordered by sid, so no two suffixes are equal.
    With `prefix`, the recursion ends when the names stand for so many symbols: suffixes that agree in them stand together, in any order.
    """
    found = _ranks(symbols.select("sid", F.lit(0).cast("long").alias("sub"), "i", "x"), prefix)
    return numbered(found.select("sid", "i", "r"), ["r"], "rank").select("sid", "i", "rank")

"""Reading inputs, row keys, and tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixhaz.sources.durable import checkpoint_dir

#: rows up to which a side of a join is sent to every task; beyond, the join shuffles
BROADCAST_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def keyed(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, text and a key of both. Other columns are left out, so that no name can clash; `carry` keeps them as a struct `row` (see `carried`).
    Rows that agree in both have one key and get one result each; rows of one doc_id with different texts are different documents."""
    key = F.xxhash64("doc_id", "text", F.col("text").isNull()).alias("key")
    return docs.select("doc_id", "text", key, *([F.struct(*[c for c in docs.columns if c != "text"]).alias("row")] if carry else []))


def carried(columns: list[str], changed: dict | None = None) -> list:
    """The columns of rows that `keyed` carries, in their order and under their names; `changed` holds new values by name."""
    changed = changed or {}
    return [changed.get(c, F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in columns]


def cut(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """Write a table to the shared checkpoint folder and read from there: a lost executor costs a re-read, not a re-run.
    `paths` remembers where it is."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    paths.clear()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, a table already cut, marked for broadcast if it has at most `rows` rows; else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def attach(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join `right` to `left` by key and doc_id, a null doc_id matching itself."""
    right = right.withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    return left.join(right, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), how).drop("_id", "_key")


def attach_few(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Like `attach` for a cut table `right`. While its keys are few they are sent to every task, so that only matching rows shuffle."""
    if right.count() > BROADCAST_ROWS:
        return attach(left, right, how)
    keys = F.broadcast(right.select("key").distinct())
    found = attach(left.join(keys, "key", "left_semi"), right, how)
    if how == "inner":
        return found
    return found.unionByName(left.join(keys, "key", "left_anti"), allowMissingColumns=True)

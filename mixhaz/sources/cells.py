"""Durable result tables by cell: staged, read back, then committed.

Rows go to a staging folder first. Only if what is read back there has the counts and fingerprints of what was to be written, the folder is renamed to
a commit, and then a manifest names the commit for each of its cells. Readers follow the manifest: whatever breaks before its rename leaves the earlier
cells as they were.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixhaz.functions.exprs import col
from mixhaz.operators.scaling import InputError
from mixhaz.sources.durable import durable

MANIFEST = "_manifest"


def _files(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _rename(spark: SparkSession, old: str, new: str) -> None:
    source, files = _files(spark, old)
    target, _ = _files(spark, new)
    files.mkdirs(target.getParent())
    if not files.rename(source, target):
        raise OSError(f"could not rename {old} to {new}")


def fingerprints(rows: DataFrame) -> DataFrame:
    """(cell, rows, fingerprint): an order-free sum of the rows' hashes, whatever the order of their columns."""
    names = sorted(rows.columns)
    return rows.groupBy("cell").agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*[col(c) for c in names]).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """(cell, rows, fingerprint, commit): the commit that holds each cell now; None before the first."""
    folder, files = _files(spark, f"{path}/{MANIFEST}")
    if not files.exists(folder):
        return None
    every = spark.read.parquet(f"{path}/{MANIFEST}/*")
    newest = F.max_by(F.struct("rows", "fingerprint", "commit"), F.struct("at", "commit"))
    return every.groupBy("cell").agg(newest.alias("now")).select("cell", "now.*")


def write_cells(results: DataFrame, path: str) -> str:
    """Replace the cells that `results` holds (column `cell`); the others stay. Returns the commit's name."""
    spark = results.sparkSession
    commit = f"c-{uuid.uuid4().hex}"
    results = durable(results)  # what is checked is what is written
    want = fingerprints(results)
    staging = f"{path}/_staging-{commit}"
    results.withColumn("of_cell", F.col("cell")).write.partitionBy("of_cell").parquet(f"{staging}/rows")  # the column itself keeps its type
    got = fingerprints(spark.read.schema(results.schema).parquet(f"{staging}/rows").select(results.columns))
    odd = want.join(got.withColumnsRenamed({"rows": "r", "fingerprint": "f"}), "cell", "full_outer").where(
        ~(F.col("rows").eqNullSafe(F.col("r")) & F.col("fingerprint").eqNullSafe(F.col("f")))).count()
    if odd:
        raise OSError(f"{odd} cell(s) were not read back as written; nothing was committed")
    named = want.select("cell", "rows", "fingerprint", F.lit(commit).alias("commit"), F.lit(time.time_ns()).alias("at"))
    named.write.parquet(f"{staging}/manifest")
    _rename(spark, f"{staging}/rows", f"{path}/commit={commit}")
    _rename(spark, f"{staging}/manifest", f"{path}/{MANIFEST}/{commit}")
    folder, files = _files(spark, staging)
    files.delete(folder, True)
    return commit


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """The committed rows of all cells, or None where nothing was written yet."""
    now = manifest(spark, path)
    if now is None:
        return None
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    return rows.join(now.select("cell", "commit"), ["cell", "commit"], "left_semi").drop("commit", "of_cell")


def open_cells(registry: DataFrame, path: str) -> DataFrame:
    """Registered cells (cell, reps) whose results are missing or incomplete."""
    done = read_results(registry.sparkSession, path)
    if done is None:
        return registry
    have = done.groupBy("cell").agg(F.count_distinct("rep").alias("_have"))
    return registry.join(have, "cell", "left").where(F.coalesce("_have", F.lit(0)) < F.col("reps")).drop("_have")


def collect_cells(registry: DataFrame, path: str) -> DataFrame:
    """All result rows in cell order; refuses while a registered cell is incomplete."""
    missing = open_cells(registry, path)
    n, first = missing.agg(F.count("*"), F.min("cell")).first()
    if n:
        raise InputError(f"{n} cells without complete results, {first} among them")
    return read_results(registry.sparkSession, path).orderBy("cell", "rep", "method")


def drop_superseded(spark: SparkSession, path: str) -> int:
    """Delete commits that no cell refers to any more, and folders of broken writes. For times without writers; returns how many went."""
    now = manifest(spark, path)
    kept = set() if now is None else {r["commit"] for r in now.select("commit").distinct().collect()}
    folder, files = _files(spark, path)
    gone = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith(("commit=", "_staging-"))
            and s.getPath().getName().removeprefix("commit=") not in kept]
    for old in gone:
        files.delete(old, True)
    return len(gone)

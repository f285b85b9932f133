"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names; a temporary one only where nothing is set and all runs on one machine (tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and (sc.master.startswith("local-cluster") or not sc.master.startswith("local")):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from there: losing an executor costs a re-read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

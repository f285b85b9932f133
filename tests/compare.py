"""Run registered queries and their SQL side by side and compare every value."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd


def sql_frame(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(f))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con.execute(sql).df()


def missing(v) -> bool:
    return v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v))


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) else
                          (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v))
    return df.sort_values(list(df.columns), key=lambda s: s.map(repr)).reset_index(drop=True)


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame, tol: float = 1e-9) -> str:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} vs {len(sql_df)}"
    a, b = canonical(spark_df), canonical(sql_df)
    bad = []
    for c in a.columns:
        for i, (x, y) in enumerate(zip(a[c], b[c])):
            same = x == y or (missing(x) and missing(y))
            if not same and isinstance(x, float) and isinstance(y, float):
                same = abs(x - y) <= tol * max(1.0, abs(x))
            if not same:
                bad.append(f"{c}[{i}]: {x!r} vs {y!r}")
    return "" if not bad else f"{len(bad)} values differ, e.g. " + "; ".join(bad[:3])


if __name__ == "__main__":
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    import __spark_entry__ as entry

    from pyspark.sql import SparkSession

    sf = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    for name in names:
        t0 = time.time()
        try:
            got = entry.queries()[name](spark, sf).toPandas()
            t1 = time.time()
            sql = entry.oracle_sql().get(name)
            verdict = "rows only" if sql is None else (differences(got, sql_frame(sf, sql)) or "ok")
            print(f"{name:28s} {len(got):7d} spark {t1 - t0:6.2f}s sql {time.time() - t1:6.2f}s {verdict}", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} FAILED {type(e).__name__}: {str(e)[:600]}", flush=True)

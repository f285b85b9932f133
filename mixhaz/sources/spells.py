"""Survival data from the order tables: one spell per order, ending at the customer's next order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STUDY_END = "2001-08-02"
FEATURES = ["f_price", "f_bal", "f_lines", "f_disc", "f_qty"]
INDICATOR = "i_building"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HOT_CUSTOMER = 1_000_000  # more orders of one customer than one task should sort


def next_order(orders: DataFrame, hot_from: int = HOT_CUSTOMER) -> DataFrame:
    """Date of the next order of the same customer.

    A customer with very many orders is split by day, so their rows sort in many
    tasks; the first order of the next day is then handed to the last one of a day.
    """
    slim = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    hot = (orders.groupBy("o_custkey").count().where(F.col("count") > hot_from)
           .select("o_custkey", F.lit(True).alias("_hot")))
    day = F.when(F.col("_hot"), F.to_date("o_orderdate"))
    slim = slim.join(hot, "o_custkey", "left").withColumn("_day", day).drop("_hot")
    inside = W.partitionBy("o_custkey", "_day").orderBy("o_orderdate", "o_orderkey")
    led = slim.withColumn("_next", F.lead("o_orderdate").over(inside))
    days = slim.where("_day is not null").groupBy("o_custkey", "_day").agg(F.min("o_orderdate").alias("_first"))
    following = days.select("o_custkey", "_day", F.lead("_first").over(
        W.partitionBy("o_custkey").orderBy("_day")).alias("_following"))
    out = led.join(following, ["o_custkey", "_day"], "left")
    return out.withColumn("next_date", F.coalesce("_next", "_following")).drop("_next", "_following", "_day")


def spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, time, status, five features and one 0/1 indicator."""
    orders = next_order(table(spark, sf_dir, "orders"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n"), F.avg("l_discount").alias("d"), F.sum("l_quantity").alias("q"))
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    end = F.lit(STUDY_END).cast("timestamp_ntz")
    gap = F.datediff(F.coalesce(F.col("next_date").cast("timestamp_ntz"), end), "o_orderdate").cast("double")
    joined = orders.join(lines, "o_orderkey", "left").join(customer, "o_custkey")
    return joined.select(
        F.col("o_orderkey").alias("id"),
        F.greatest(gap, F.lit(0.1)).alias("time"),
        F.col("next_date").isNotNull().cast("int").alias("status"),
        F.col("o_totalprice").alias("f_price"),
        F.col("c_acctbal").alias("f_bal"),
        F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("f_lines"),
        F.coalesce("d", F.lit(0.0)).alias("f_disc"),
        F.coalesce("q", F.lit(0.0)).alias("f_qty"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("i_building"),
    )

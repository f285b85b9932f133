"""The corpus pipeline: stages that each read what the one before has kept, written as Parquet in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixhaz.llm.byte_pairs import encode_decode, public_vocabulary
from mixhaz.llm.contamination import without_contaminated
from mixhaz.llm.near_duplicates import without_near_duplicates
from mixhaz.llm.suffix_dedup import without_repeats
from mixhaz.llm.tables import cut, read
from mixhaz.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (shingles of five words, similarity 0.8)."""
    return without_near_duplicates(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes and more that stand elsewhere, too, are cut out of the texts."""
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every document, and the text that the ids decode to."""
    return encode_decode(docs, *public_vocabulary()).select("doc_id", "n_tokens", "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings),
          ("decontamination", decontamination), ("tokens", tokens)]

#: the stages are not expressible in SQL; tests compare them with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs

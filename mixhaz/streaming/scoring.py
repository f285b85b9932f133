"""Scoring a stream with a fitted model. Predictions are map-only, so they need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mixhaz.plans.model import MixtureModel


def score_stream(model: MixtureModel, stream: DataFrame, type: str = "tau", times=None) -> DataFrame:
    """Membership, risk or survival predictions for every arriving row."""
    if not stream.isStreaming:
        raise ValueError("score_stream() takes a streaming DataFrame; use model.predict() for a batch one.")
    return model.predict(stream, type, times)


def write_scores(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append scored rows to parquet; restarts continue from `checkpoint` without loss or repeats."""
    return (scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())

"""Scoring of a stream: binding and scoring are stateless projections, so a stream takes them as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import predict_diagnostics
from ..plans.tables import Model


def score_stream(stream: DataFrame, model: Model) -> DataFrame:
    """predict_diagnostics over a streaming frame; models bound by join are refused."""
    if not stream.isStreaming:
        raise ValueError("the frame is not a stream")
    return predict_diagnostics(stream, model)


def write_scores(stream: DataFrame, model: Model, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the scored rows of a stream to Parquet; the checkpoint makes it exactly once."""
    return score_stream(stream, model).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

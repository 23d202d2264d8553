"""Score a streaming DataFrame with a fitted pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(model: PipelineModel, stream: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """``model.transform`` on a streaming DataFrame; optionally keep only some columns."""
    out = model.transform(stream)
    return out.select(*keep) if keep else out


def start_scoring(model: PipelineModel, stream: DataFrame, sink_path: str, checkpoint: str,
                  keep: Sequence[str] | None = None) -> StreamingQuery:
    """Append scored rows to Parquet. A restart with the same ``checkpoint`` goes on where the last ended."""
    return (
        score_stream(model, stream, keep)
        .writeStream.format("parquet")
        .option("path", sink_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .start()
    )

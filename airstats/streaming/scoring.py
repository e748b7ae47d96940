"""Score requests as they arrive."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from airstats.plans.scoring import score, with_text


def score_stream(model: Transformer, stream: DataFrame) -> DataFrame:
    """A stream of feature rows with class, probabilities, text and percent. Keeps no state."""
    return with_text(score(model, stream))


def write_scores(scored: DataFrame, dst: str, checkpoint: str) -> StreamingQuery:
    """Score what is there and stop; the file sink's log makes every row arrive once."""
    return (
        scored.writeStream.format("parquet").option("path", dst).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )

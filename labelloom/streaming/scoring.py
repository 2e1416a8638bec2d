"""A stream of requests answered by a fitted model."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from labelloom import constants as C
from labelloom.plans.scoring import answer_requests


def stream_score(
    requests: DataFrame,
    model: Transformer,
    sink: str,
    checkpoint: str,
    names: dict[int, str] = C.SERVING_NAMES,
    **trigger: object,
) -> StreamingQuery:
    """Write the answers of a stream of requests to a Parquet sink."""
    answers = answer_requests(requests, model, names)
    writer = answers.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()

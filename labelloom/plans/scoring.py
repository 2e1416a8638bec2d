"""Requests in, answers out."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import DataFrame

from labelloom import constants as C
from labelloom.functions import text as T
from labelloom.operators.classifier import predict
from labelloom.operators.tables import respond, validate_requests


def answer_requests(requests: DataFrame, model: Transformer, names: dict[int, str] = C.SERVING_NAMES) -> DataFrame:
    """Requests with a ``text``, batch or stream, with the JSON ``response`` of each."""
    checked = validate_requests(requests)
    clean = checked.withColumn("text", T.collapse_whitespace("text"))
    answered = respond(predict(clean, model), names=names)
    return answered.select(*requests.columns, "response")

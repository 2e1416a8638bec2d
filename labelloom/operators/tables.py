"""Column repairs, request checks and the union of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import constants as C
from labelloom.functions import text as T
from labelloom.functions.labels import label_from_word
from labelloom.functions.scores import error_json, success_json


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    """Strip a text column and drop the rows where nothing is left."""
    return df.withColumn(column, T.strip_text(column)).filter(F.col(column) != "")


def map_label_words(df: DataFrame, column: str = "sentiment") -> DataFrame:
    """Label words become codes; other words become NULL."""
    return df.withColumn(column, label_from_word(column))


def ensure_column(df: DataFrame, column: str = "class", value: object = C.DEFAULT_LABEL) -> DataFrame:
    """Add a constant column unless it is there."""
    return df if column in df.columns else df.withColumn(column, F.lit(value))


def cast_text(df: DataFrame, column: str = "text", null_text: str | None = None) -> DataFrame:
    """Make a column text. NULL stays NULL unless a text for it is given."""
    text = F.col(column).cast("string")
    return df.withColumn(column, text if null_text is None else F.coalesce(text, F.lit(null_text)))


def to_training_columns(df: DataFrame) -> DataFrame:
    """Encoded rows as the three columns a trainer reads."""
    if "class" in df.columns:
        df = df.withColumnRenamed("class", "labels")
    return df.select("input_ids", "attention_mask", "labels")


def combine_sources(**sources: DataFrame) -> DataFrame:
    """All rows of all sources, each with the name of its ``source``."""
    named = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b), named)


def validate_requests(df: DataFrame, text: str = "text") -> DataFrame:
    """Strip the request text and mark requests without any with status ``error`` and a message."""
    stripped = F.coalesce(T.strip_text(text), F.lit(""))
    missing = stripped == ""
    return df.withColumns({
        text: stripped,
        "status": F.when(missing, "error").otherwise("success"),
        "message": F.when(missing, C.MISSING_TEXT_MESSAGE),
    })


def respond(df: DataFrame, prediction: str = "prediction", names: dict[int, str] = C.SERVING_NAMES) -> DataFrame:
    """Add ``response``, the JSON answer to a checked request with a predicted class."""
    ok = success_json(F.col(prediction).cast("int"), names)
    return df.withColumn("response", F.when(F.col("status") == "success", ok).otherwise(error_json("message")))

"""Labelled lines inside generated responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import constants as C
from labelloom.functions import text as T


def parse_generated_lines(
    df: DataFrame,
    response: str = "response",
    expected: str = "label",
    keep: Sequence[str] = (),
    min_chars: int = C.MIN_CHARS,
    max_chars: int = C.MAX_CHARS,
) -> DataFrame:
    """Rows ``(keep..., line_no, sentence, sentiment)`` for the acceptable lines of each response.

    A line is ``<sentence>,<label>``. It is kept when its label is the expected one and the sentence,
    once quotes are removed, has a length within bounds. The sentence is not stripped.
    """
    lines = df.select(
        *keep, F.col(expected).alias("_expected"), F.posexplode(F.split(T.strip_text(response), "\n")).alias("line_no", "_line")
    )
    parsed = lines.filter(F.contains("_line", F.lit(","))).select(
        *keep,
        "line_no",
        T.remove_quotes(T.before_last_comma("_line")).alias("sentence"),
        T.strip_text(T.after_last_comma("_line")).alias("_label"),
        F.col("_expected").cast("string"),
        F.col("_expected").cast("int").alias("sentiment"),
    )
    wanted = (F.col("_label") == F.col("_expected")) & T.has_sentence_length("sentence", min_chars, max_chars)
    return parsed.filter(wanted).drop("_label", "_expected")

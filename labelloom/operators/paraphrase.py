"""Requests to rewrite sentences, and the answers put back in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import constants as C
from labelloom.functions import text as T
from labelloom.functions.labels import label_name


def render_paraphrase_requests(
    df: DataFrame,
    key: Sequence[str],
    sentence: str = "sentence",
    label: str = "sentiment",
    splits: Sequence[str] | None = ("val", "test"),
) -> DataFrame:
    """Rows ``(key..., prompt)``: one request per row of the named splits, or per row without splits."""
    rows = df.filter(F.col("split").isin(*splits)) if splits else df
    prompt = T.paraphrase_request(sentence, label_name(label, C.PROMPT_NAMES, C.PROMPT_DEFAULT))
    return rows.select(*key, prompt.alias("prompt"))


def join_paraphrases(df: DataFrame, answers: DataFrame, key: Sequence[str], answer: str = "answer") -> DataFrame:
    """Every row with its answer, NULL when there is none.

    No key multiplies its rows: of several answers to one key the least in order of text counts, blank ones and NULL last.
    """
    said = F.when(T.strip_text(answer) != "", F.col(answer))
    one = answers.groupBy(*key).agg(F.coalesce(F.min(said), F.min(answer)).alias(answer))
    return df.join(one, list(key), "left")


def apply_paraphrases(
    df: DataFrame,
    answers: DataFrame,
    key: Sequence[str],
    sentence: str = "sentence",
    answer: str = "answer",
    splits: Sequence[str] | None = None,
) -> DataFrame:
    """Replace each sentence by its cleaned answer; rows without an answer keep the original.

    With ``splits`` only those splits are joined, and the others pass by without a shuffle.
    """
    if splits:
        asked = F.col("split").isin(*splits)
        rest = df.filter(~F.coalesce(asked, F.lit(False)))
        return rest.unionByName(apply_paraphrases(df.filter(asked), answers, key, sentence, answer))
    joined = join_paraphrases(df, answers.withColumnRenamed(answer, "_answer"), key, "_answer")
    rewritten = F.coalesce(T.clean_answer("_answer"), F.col(sentence))
    return joined.withColumn(sentence, rewritten).select(*df.columns)

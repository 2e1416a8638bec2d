"""Fit, choose and measure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators.classifier import DEFAULT_CANDIDATES, FEATURES, count_words, each_pass, fit_classifier, predict
from labelloom.operators.metrics import metrics_by_split
from labelloom.staging import stage


def train_and_evaluate(
    corpus: DataFrame, candidates: Sequence[dict] = DEFAULT_CANDIDATES, features: int = FEATURES
) -> tuple[PipelineModel, DataFrame]:
    """Fit on train, choose on val and measure all splits of ``(split, text, class)``.

    The texts are read once; every later pass reads the word counts written to the shared folder.
    """
    counts = _counted(corpus, features)
    model, _ = fit_classifier(*_train_and_val(counts), candidates, features)
    return model, metrics_by_split(predict(counts, model))


def train_by_pass(
    corpus: DataFrame, candidate: dict = DEFAULT_CANDIDATES[0], features: int = FEATURES
) -> tuple[PipelineModel, DataFrame]:
    """Fit on train and measure train and val after every pass: the model of the pass that does best on val, and a row of
    figures per pass, the first of equal ones taken."""
    return fit_classifier(*_train_and_val(_counted(corpus, features)), each_pass(candidate), features)


def _counted(corpus: DataFrame, features: int) -> DataFrame:
    rows = corpus.select("split", "text", F.col("class").cast("double").alias("label"))
    return stage(count_words(rows, features), "counts")


def _train_and_val(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    return counts.filter("split = 'train'"), counts.filter("split = 'val'")

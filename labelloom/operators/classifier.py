"""Three-class text classifier on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from labelloom import constants as C
from labelloom.functions import text as T
from labelloom.functions.labels import label_name
from labelloom.functions.scores import argmax, negative_log_likelihood, probability_map
from labelloom.operators.metrics import accuracy, f1, select_best
from labelloom.staging import stage

FEATURES = 1 << 15
_FIGURES = "candidate int, passes int, objective double, train_loss double, train_accuracy double, val_loss double, val_accuracy double, val_f1 double"
DEFAULT_CANDIDATES = ({"reg": C.WEIGHT_DECAY, "passes": C.MAX_PASSES},)


def _counters(features: int) -> list[Transformer]:
    """The stages that need no fitting: words, cut where :func:`labelloom.functions.text.tokens` does, then hashed counts."""
    return [
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=T.RUN_OF_WHITESPACE),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
    ]


def each_pass(candidate: dict) -> list[dict]:
    """A candidate as it stands after each of its passes, the first to the last.

    The optimiser starts from zero and takes the same steps every time, so stopping it after ``k`` passes gives the
    coefficients of the whole fit after ``k``. What that costs is passes over the word counts: 78 for a course of 12.
    """
    return [{**candidate, "passes": n} for n in range(1, candidate["passes"] + 1)]


def count_words(df: DataFrame, features: int = FEATURES) -> DataFrame:
    """The rows with ``_counts`` in place of ``text``. A missing text counts as an empty one."""
    counted = df.withColumn("text", F.coalesce("text", F.lit("")))
    for counter in _counters(features):
        counted = counter.transform(counted)
    return counted.drop("text", "_words")


def fit_classifier(
    train: DataFrame,
    validation: DataFrame | None = None,
    candidates: Sequence[dict] = DEFAULT_CANDIDATES,
    features: int = FEATURES,
) -> tuple[PipelineModel, DataFrame | None]:
    """Fit every candidate on ``(text, label)`` and return the best by validation F1 with all figures.

    Figures are a row per candidate: the passes allowed, the objective that they reach (loss and penalty), loss and accuracy on
    train, loss, accuracy and F1 on validation. With the candidates of :func:`each_pass` that is the course of one fit. Without a validation table there is nothing to choose by: one candidate is fitted, more are an
    error, and there are no figures. Words are counted once and written to the shared folder: all
    passes of all candidates read the counts.
    """
    if validation is None and len(candidates) != 1:
        raise ValueError("several candidates need a validation table")

    def counts(df: DataFrame) -> DataFrame:
        return df if "_counts" in df.columns else stage(count_words(df.select("text", "label"), features), "counts")

    train = counts(train)
    idf = IDF(inputCol="_counts", outputCol="_features").fit(train)
    weighted = idf.transform(train)
    held_out = idf.transform(counts(validation)) if validation is not None else None
    models, rows = [], []
    for number, candidate in enumerate(candidates):
        model = LogisticRegression(
            featuresCol="_features",
            labelCol="label",
            family="multinomial",
            maxIter=candidate["passes"],
            regParam=candidate["reg"],
        ).fit(weighted)
        models.append(PipelineModel([*_counters(features), idf, model]))
        if held_out is not None:
            on_train = model.transform(weighted).agg(_loss(), accuracy()).first()
            rows.append((number, candidate["passes"], float(model.summary.objectiveHistory[-1]), *on_train, *model.transform(held_out).agg(_loss(), accuracy(), f1()).first()))
    if validation is None:
        return models[0], None
    figures = train.sparkSession.createDataFrame(rows, _FIGURES)
    return models[select_best(figures).first()["candidate"]], figures


def _loss() -> Column:
    return F.avg(negative_log_likelihood(vector_to_array("probability"), F.col("label").cast("int")))


def predict(df: DataFrame, model: Transformer) -> DataFrame:
    """The rows with ``probabilities``, an array, and ``prediction``, the most likely class.

    ``model`` is any transformer of ``text`` that adds ``probability`` as a vector or an array. A missing
    text counts as an empty one. Rows that hold ``_counts`` already go through the fitted stages only.
    """
    if "_counts" in df.columns:
        scored = PipelineModel(model.stages[-2:]).transform(df)
    else:
        scored = model.transform(df.withColumn("text", F.coalesce("text", F.lit(""))))
    is_array = isinstance(scored.schema["probability"].dataType, ArrayType)
    probabilities = F.col("probability") if is_array else vector_to_array("probability")
    return scored.withColumn("probabilities", probabilities).select(
        *df.columns, "probabilities", argmax("probabilities").alias("prediction")
    )


def score_probabilities(df: DataFrame, names: dict[int, str] = C.OFFLINE_NAMES, keep: Sequence[str] = ()) -> DataFrame:
    """Rows ``(keep..., text, sentiment, confidence, probabilities)`` from an array of probabilities."""
    p = F.col("probabilities")
    return df.select(
        *keep,
        "text",
        label_name(argmax(p), names, default=None).alias("sentiment"),
        F.array_max(p).alias("confidence"),
        probability_map(p, names).alias("probabilities"),
    )


def score(df: DataFrame, model: Transformer, names: dict[int, str] = C.OFFLINE_NAMES, keep: Sequence[str] = ()) -> DataFrame:
    """Score texts with a fitted model."""
    return score_probabilities(predict(df, model), names, keep)

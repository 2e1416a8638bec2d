"""Accuracy, F1 and loss, pooled over all rows of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom import constants as C
from labelloom.functions.scores import log_loss_of_logits, negative_log_likelihood


def accuracy(prediction: str = "prediction", label: str = "label") -> Column:
    """Share of right predictions, NULL without rows."""
    return F.avg((F.col(prediction) == F.col(label)).cast("double"))


def f1(prediction: str = "prediction", label: str = "label") -> Column:
    """2TP / (2TP + FP + FN), the counts of all classes there are added up; NULL without rows.

    Pooled over classes, a wrong prediction is one FP and one FN, so no list of classes is needed.
    """
    right = F.count_if(F.col(prediction) == F.col(label))
    wrong = F.count_if(F.col(prediction) != F.col(label))
    return F.try_divide((2 * right).cast("double"), (2 * right + 2 * wrong).cast("double"))


def micro_accuracy(df: DataFrame, by: Sequence[str] = (), prediction: str = "prediction", label: str = "label") -> DataFrame:
    return df.groupBy(*by).agg(accuracy(prediction, label).alias("accuracy"))


def micro_f1(df: DataFrame, by: Sequence[str] = (), prediction: str = "prediction", label: str = "label") -> DataFrame:
    return df.groupBy(*by).agg(f1(prediction, label).alias("f1"))


def cross_entropy(
    df: DataFrame, by: Sequence[str] = (), probabilities: str | None = None, logits: str | None = None, label: str = "label"
) -> DataFrame:
    """Mean loss over rows, from probabilities or from logits."""
    loss = log_loss_of_logits(logits, label) if logits else negative_log_likelihood(probabilities, label)
    return df.groupBy(*by).agg(F.avg(loss).alias("loss"))


def metrics_by_split(
    df: DataFrame,
    prediction: str = "prediction",
    label: str = "label",
    baseline: tuple[float, float] | None = (C.BASELINE_ACCURACY, C.BASELINE_F1),
) -> DataFrame:
    """Rows ``(dataset, accuracy, f1)`` per split, with a constant row to compare with."""
    name = F.coalesce(*[F.when(F.col("split") == s, n) for s, n in C.DATASET_NAMES.items()], F.col("split"))
    measured = (
        df.groupBy("split")
        .agg(accuracy(prediction, label).alias("accuracy"), f1(prediction, label).alias("f1"))
        .select(name.alias("dataset"), "accuracy", "f1")
    )
    if baseline is None:
        return measured
    values = [F.lit(v).alias(n) for n, v in zip(("dataset", "accuracy", "f1"), (C.BASELINE_NAME, *baseline))]
    return measured.unionByName(df.sparkSession.range(1).select(*values))


def select_best(metrics: DataFrame, by: str = "val_f1", mode: str = "max", candidate: str = "candidate") -> DataFrame:
    """One row ``(candidate, <by>)``: the best candidate, the lowest of equal ones."""
    value = -F.col(by) if mode == "max" else F.col(by)
    best = F.min_by(F.struct(candidate, by), F.struct(value, F.col(candidate)))
    return metrics.agg(best.alias("_best")).select("_best.*")

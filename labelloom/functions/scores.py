"""Arrays of class scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom import constants as C
from labelloom.functions.labels import label_name


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def _powers(logits: Column) -> Column:
    """Exponentials after the largest logit is subtracted, so that none overflows."""
    return _with(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))


def softmax(logits: Column | str) -> Column:
    """Probabilities of an array of logits."""

    def shares(powers: Column) -> Column:
        return _with(_sum(powers), lambda total: F.transform(powers, lambda e: e / total))

    return _with(_col(logits), lambda x: _with(_powers(x), shares))


def argmax(p: Column | str) -> Column:
    """Index of the largest value, the first one on ties."""
    return _with(_col(p), lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("int"))


def negative_log_likelihood(p: Column | str, label: Column | str) -> Column:
    """-ln p[label]; infinite where the class got no probability at all."""
    at_label = F.get(_col(p), _col(label))
    return F.when(at_label > 0, -F.log(at_label)).when(at_label == 0, F.lit(float("inf")))


def log_loss_of_logits(logits: Column | str, label: Column | str) -> Column:
    """The same loss taken straight from the logits."""
    label = _col(label)
    return _with(_col(logits), lambda x: F.array_max(x) + F.log(_sum(_powers(x))) - F.get(x, label))


def probability_map(p: Column | str, names: dict[int, str] = C.OFFLINE_NAMES) -> Column:
    """Display name to probability with four decimals."""
    p = _col(p)
    codes = sorted(names)
    texts = [F.format_string("%.4f", F.get(p, F.lit(code))) for code in codes]
    return F.create_map(*[x for code, text in zip(codes, texts) for x in (F.lit(names[code]), text)])


def success_json(label: Column | str, names: dict[int, str] = C.SERVING_NAMES) -> Column:
    data = F.struct(label_name(label, names, default=None).alias("classify"))
    return F.to_json(F.struct(F.lit("success").alias("status"), data.alias("data")))


def error_json(message: Column | str) -> Column:
    return F.to_json(F.struct(F.lit("error").alias("status"), _col(message).alias("message")))

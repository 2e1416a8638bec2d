"""Rows accepted per category until its quota is full."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom import constants as C
from labelloom.functions import text as T
from labelloom.operators.cuts import range_cuts
from labelloom.operators.joins import join_heavy_apart
from labelloom.staging import stage

KEYS = ("category", "label")


def category_table(spark: SparkSession, categories: dict[str, int] = C.CATEGORIES) -> DataFrame:
    entries = F.create_map(*[F.lit(x) for pair in categories.items() for x in pair])
    return spark.range(1).select(F.explode(entries).alias("category", "label"))


def progress(sink: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows already accepted per category, counted from the stored rows themselves."""
    return sink.groupBy(*keys).agg(F.count("*").alias("n"))


def join_progress(categories: DataFrame, done: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every category with its number of stored rows, 0 when it has none."""
    joined = categories.join(done, list(keys), "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0)))


def remaining_quota(
    categories: DataFrame, done: DataFrame, target: int = C.TARGET_PER_CATEGORY, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Categories that still need rows, and how many."""
    missing = F.greatest(F.lit(target) - F.col("n"), F.lit(0)).alias("remaining")
    return join_progress(categories, done, keys).select(*keys, missing).filter("remaining > 0")


def total_generated(categories: DataFrame, done: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row: stored rows over all categories, finished ones included."""
    return join_progress(categories, done, keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def with_category_key(df: DataFrame, category: str = "category", label: str = "label") -> DataFrame:
    return df.withColumn("category_key", T.category_key(category, label))


def accept_to_quota(
    batch: DataFrame, remaining: DataFrame, arrival: Sequence[str], keys: Sequence[str] = KEYS
) -> DataFrame:
    """The first ``remaining`` rows of each category in arrival order; finished categories give none.

    ``arrival`` is unique inside a category; NULL arrives first. Quotas of every size take the same way: the
    last key each category accepts is found by counting, see :func:`labelloom.operators.cuts.range_cuts`, and
    the rows themselves are filtered without a shuffle.
    """
    # a row per category, used more than once; rows without a category fill none
    remaining = stage(remaining.dropna(subset=list(keys)), "remaining")
    # The row is carried whole, so that its columns may have any names. Two arrival columns at least make the key a
    # struct, so that a NULL arrival differs from no cut at all.
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    names, order = [f"_k{i}" for i in range(len(keys))], [f"_a{i}" for i in range(len(arrival) + 1)]
    place = [F.col(a).alias(n) for a, n in zip(arrival, order)] + [F.lit(0).alias(order[-1])]
    limits = remaining.select(*own, F.col("remaining").alias("_open"))
    # The last accepted position of each category; past the end, while it stays open, there is no key.
    asked = join_heavy_apart(batch.select(*own, *place), limits, names)
    cuts = range_cuts(asked, order, {"_last": lambda n: F.col("_open") - 1}, [*names, "_open"])
    rows = batch.select(*own, F.struct(*place).alias("_place"), F.struct(*batch.columns).alias("_row"))
    rows = join_heavy_apart(rows, cuts.select(*names, "_last"), names)
    return rows.filter(F.col("_last").isNull() | (F.col("_place") <= F.col("_last"))).select("_row.*")

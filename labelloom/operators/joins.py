"""Join helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.staging import stage

SMALL_ROWS = 200_000
SMALL_BYTES = 32 << 20
# Keys of more than one row in so many are heavy; there are fewer than that.
_SHARE = 1000


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL equals NULL; the result keeps the keys of ``left``."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def is_small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> bool:
    """Whether a table fits the bounds for a broadcast, both in rows and in bytes.

    Looks at no more than ``rows + 1`` rows.
    """
    width = F.octet_length(F.struct(*df.columns).cast("string"))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("size")).first()
    return found["n"] <= rows and found["size"] <= size


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    """``df`` marked for broadcast when it is small. Above the bounds the join is left to Spark, which shuffles."""
    return F.broadcast(df) if is_small(df, rows, size) else df


def join_heavy_apart(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`join_null_safe` of many rows with a written table that has at most one row per key.

    A small table is broadcast. From a larger one only the heavy keys are, those of more than one in ``_SHARE`` rows of
    ``left``, which are counted first; their rows stay where they are. Rows of other keys are shuffled, and no key can fill
    a task. ``left`` is read once for each, so it must give the same rows again.
    """
    if is_small(right):
        return join_null_safe(left, F.broadcast(right), keys)
    heavy = heavy_keys(left, keys)
    known = F.broadcast(join_null_safe(right, F.broadcast(heavy), keys))  # at most a row for each
    light = join_null_safe(left, F.broadcast(heavy), keys, "left_anti")
    return join_null_safe(left, known, keys).unionByName(join_null_safe(light, right, keys))


def heavy_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of more than one in ``_SHARE`` rows, written to the shared folder."""
    counts = stage(df.groupBy(*keys).agg(F.count("*").alias("_n")), "key-counts")
    least = counts.agg((F.sum("_n") / _SHARE).alias("n")).scalar()
    return stage(counts.filter(F.col("_n") > least).select(*keys), "heavy")

"""Sums of looked-up values over the keys of each row, where the table of values has no bound.

The commonest keys, a fixed number of them, are sent to every task and cover most of what rows hold. The
other keys are joined. None of those is hot: a key outside the first ``HEAD`` has at most one part in
``HEAD`` of all occurrences.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.staging import stage

#: Keys sent to every task: 8 bytes each, and 8 more for each value.
HEAD = 200_000


class Head:
    """Sorted keys with their values, one array of values per name."""

    def __init__(self, keys: np.ndarray, values: Sequence[np.ndarray]) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], [v[order] for v in values]

    def split(self, keys: np.ndarray, times: np.ndarray, row: np.ndarray, n: int) -> tuple[list[np.ndarray], pa.ListArray]:
        """For ``n`` rows with keys that occur so many times (``row`` rises): sums of the values known here, and the other
        keys, as lists of structs."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        at, own = at[known], row[known]
        sums = []
        for values in self.values:
            total = np.zeros(n, values.dtype)
            np.add.at(total, own, values[at] * times[known])
            sums.append(total)
        ends = np.zeros(n + 1, np.int32)
        np.cumsum(np.bincount(row[~known], minlength=n), out=ends[1:])
        rest = pa.StructArray.from_arrays([pa.array(keys[~known], pa.int64()), pa.array(times[~known], pa.int64())], names=["key", "times"])
        return sums, pa.ListArray.from_arrays(pa.array(ends), rest)


REST = "array<struct<key:long,times:long>>"


def head_of(table: DataFrame, names: Sequence[str], by: str, most: int = HEAD) -> Head:
    """The ``most`` rows of ``table`` (``key`` and the named values) with the largest ``by``."""
    found = table.orderBy(F.desc(by), "key").limit(most).select("key", *names).toArrow()
    return Head(found.column("key").to_numpy(), [found.column(n).to_numpy() for n in names])


def with_rest(rows: DataFrame, table: DataFrame, names: Sequence[str], row: str = "_row", rest: str = "_rest") -> DataFrame:
    """``row`` and the sums of ``rows``: those already in the columns ``names`` and those of the keys in ``rest``.

    ``rows`` and ``table`` are read more than once, so both should be staged. Keys without a value add nothing.
    """
    other = rows.select(row, F.explode(rest).alias("_e")).select(row, "_e.key", "_e.times")
    added = other.join(table.select("key", *names), "key").select(row, *[(F.col(n) * F.col("times")).alias(n) for n in names])
    return rows.select(row, *names).unionAll(added).groupBy(row).agg(*[F.sum(n).alias(n) for n in names])


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written with a number for each in ``_row``, the same at every later reading."""
    return stage(rows.withColumn("_row", F.monotonically_increasing_id()), name)

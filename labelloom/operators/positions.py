"""Row positions.

DataFrames have no order, so a position is worked out from a key, from a hash, or from the place in
a file. In each case rows are numbered inside many small chunks at once, and a tiny table of chunk
sizes turns those numbers into positions: no task sees a whole table or a whole group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.operators.joins import join_null_safe
from labelloom.staging import stage

# Hash order uses chunks named by the first hex digits of the hash: at most 16 ** 4 of them.
_CHUNK_DIGITS = 4


def _number(staged: DataFrame, group_by: Sequence[str], chunk_by: Sequence[str], pos: str, total: str | None) -> DataFrame:
    """Turn ``_row``, increasing by one inside each chunk, into positions inside each group."""
    sizes = staged.groupBy(*group_by, *chunk_by).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    group = Window.partitionBy(*group_by)
    # part files are in order of their numbers, which have five digits or more
    number = [F.regexp_extract("_file", r"/part-(\d+)[^/]*$", 1).try_cast("long")] if "_file" in chunk_by else []
    earlier = group.orderBy(*number, *chunk_by).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        *group_by,
        *chunk_by,
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        *([F.sum("_n").over(group).alias(total)] if total else []),
    )
    if not group_by and list(chunk_by) == ["_part"]:
        numbered = staged.join(F.broadcast(shifts), "_part")  # one row per partition of the sort
    else:
        # Written, so that Spark knows its size and broadcasts it only while it is small.
        numbered = join_null_safe(staged, stage(shifts, "shifts"), [*group_by, *chunk_by])
    return numbered.withColumn(pos, F.col("_row") + F.col("_shift")).drop("_row", "_shift")


def with_positions(
    df: DataFrame,
    order_by: Sequence[str],
    group_by: Sequence[str] = (),
    pos: str = "pos",
    total: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in key order, per group if ``group_by`` is given.

    ``order_by`` must be unique (inside a group). Rows are range-partitioned and sorted once, so even
    one group that holds most rows is spread over many tasks. The sorted rows are written to the
    shared folder because range bounds come from a sample and may differ between two evaluations.
    """
    keys = [*group_by, *order_by]
    args = [partitions, *keys] if partitions else keys
    ranged = df.repartitionByRange(*args).sortWithinPartitions(*keys)
    staged = stage(
        ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "sorted"
    )
    return _number(staged, group_by, ["_part"], pos, total).drop("_part")


def hash_of(key_by: Sequence[str], seed: int | str, method: str = "xxhash64") -> Column:
    """A hash of key and seed: ``xxhash64``, or ``md5`` of all parts joined by '-', which other engines can repeat."""
    if method == "md5":
        return F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in key_by], F.lit(str(seed))))
    return F.xxhash64(*key_by, F.lit(str(seed)))


def chunk_of(hashed: str, digits: int, method: str = "xxhash64") -> Column:
    """The first hex digits of a hash. They rise with the hash."""
    return F.substring(hashed, 1, digits) if method == "md5" else F.shiftright(hashed, 64 - 4 * digits)


def with_hash_positions(
    df: DataFrame, key_by: Sequence[str], seed: int | str, pos: str = "pos", method: str = "xxhash64"
) -> DataFrame:
    """Add the 0-based position of each row in hash order. ``key_by`` must be unique.

    Hashes spread evenly, so their first digits are the chunks and nothing has to be sampled or
    written: one narrow count of at most 65,536 chunks, then one shuffle of the rows.
    """
    hashed = df.withColumn("_hash", hash_of(key_by, seed, method))
    hashed = hashed.withColumn("_chunk", chunk_of("_hash", _CHUNK_DIGITS, method))
    sizes = hashed.groupBy("_chunk").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_chunk").orderBy("_hash", *key_by)
    numbered = hashed.join(F.broadcast(shifts), "_chunk")
    number = F.col("_shift") + F.row_number().over(inside) - 1
    return numbered.withColumn(pos, number).drop("_hash", "_chunk", "_shift")


def permuted(pos: Column, n: int, key: str, method: str = "xxhash64") -> Column:
    """The place of ``pos`` in an order of 0 .. n - 1 fixed by ``key``: a permutation worked out by arithmetic, without a shuffle.

    Swap-or-not: each round pairs every number with its mirror image about a point of its own, and a bit hashed from the larger
    of the two swaps both or neither. So every round is a permutation whatever ``n`` is, and no value ever has to be drawn
    again. Six rounds per binary digit of ``n`` mix it well.
    """
    middles = [int(hashlib.md5(f"{key}-{r}".encode()).hexdigest()[:15], 16) % max(n, 1) for r in range(6 * n.bit_length())]
    rounds = F.array(*[F.struct(F.lit(f"{key}-{r}").alias("key"), F.lit(m).cast("long").alias("middle")) for r, m in enumerate(middles)])

    def step(x: Column, one: Column) -> Column:
        mirror = (one["middle"] - x + n) % n
        larger = F.greatest(x, mirror)
        swap = F.substring(F.md5(F.concat_ws("-", one["key"], larger)), 1, 1) >= "8" if method == "md5" else F.xxhash64(one["key"], larger) < 0
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(rounds, pos.cast("long"), step) if middles else pos.cast("long")


def with_file_positions(df: DataFrame, pos: str = "pos", total: str | None = None) -> DataFrame:
    """Add the 0-based position of each row in its file, or in a folder of part files in name order.

    ``df`` comes straight from a file source, perhaps filtered, and holds ``_file`` and ``_block``
    from :func:`file_columns`. Every block is read in order by one task. The rows are written to the
    shared folder because how files are cut into blocks may differ between two evaluations.
    """
    staged = stage(df.withColumn("_row", F.monotonically_increasing_id()), "lines")
    return _number(staged, (), ["_file", "_block"], pos, total).drop("_file", "_block")


def file_columns() -> dict[str, Column]:
    return {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")}

"""Keys found at given ranks.

"The first 80 % of the rows" needs no position for every row, only the key at which the last 20 %
begin. The key columns alone are ranked; the table itself is then labelled by comparing its key
with the cut, in one pass and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.operators.joins import join_heavy_apart, join_null_safe
from labelloom.operators.positions import chunk_of, hash_of
from labelloom.staging import stage

Ranks = dict[str, Callable[[Column], Column]]

# Hash cuts count rows per group and per first hex digits of the hash: 16 ** 3 chunks of each group.
_CUT_DIGITS = 3
# Range cuts: rows of a group that are few enough to rank, keys sampled from a larger one, and how many standard errors of
# the sample lie between a rank and the keys that bracket it.
_RANKED_ROWS, _SAMPLE, _ERRORS = 100_000, 4_000, 4.0


def key_of(*columns: str | Column) -> Column:
    """One column as it is, so that comparisons with it can reach the scan, or several as a struct."""
    if len(columns) > 1:
        return F.struct(*columns)
    return F.col(columns[0]) if isinstance(columns[0], str) else columns[0]


def range_cuts(df: DataFrame, order_by: Sequence[str], ranks: Ranks, group_by: Sequence[str] = ()) -> DataFrame:
    """Per group: the key, see :func:`key_of`, at each rank in key order, or NULL past the end.

    ``ranks`` maps a column name to a function of the group's row count. NULL keys come first.

    Nothing is sorted and no table of all keys is written. In a group of many rows a rank is bracketed by two
    keys of a bounded sample (Floyd and Rivest 1975): one pass counts the rows below the lower key and keeps what lies
    between the two, as distinct keys with their counts, so that ties are one row. That is a few in a hundred of the
    rows; they are bracketed again until they are few enough to rank. A rank that falls outside its bracket is looked
    for on the side where it must be.
    """
    names = list(ranks)
    rows = df.select(*group_by, F.struct(*order_by).alias("_key"), F.lit(1).cast("long").alias("_n"))
    found = _keys_at(rows, group_by, names, lambda sizes: sizes.withColumns({n: r(F.col("_total")).cast("long") for n, r in ranks.items()}))
    values = [(F.col(n) if len(order_by) > 1 else F.col(n)[order_by[0]]).alias(n) for n in names]
    return stage(found.select(*group_by, *values), "cuts")


def _keys_at(rows: DataFrame, by: Sequence[str], names: Sequence[str], with_ranks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``by`` and a column per name: the key at its rank among ``rows``, which have ``by``, ``_key`` and ``_n``, how often
    the key stands for a row. ``with_ranks`` adds the ranks to a table of groups."""
    sizes = with_ranks(rows.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"), F.count("*").alias("_rows")))
    inside = [F.when((F.col(n) >= 0) & (F.col(n) < F.col("_total")), F.col(n)).alias(n) for n in names]
    targets = stage(sizes.select(*by, "_total", "_rows", *inside), "ranks")
    many = F.col("_rows") > _RANKED_ROWS
    kinds = targets.agg(F.coalesce(F.bool_or(many), F.lit(False)).alias("large"), F.coalesce(F.bool_or(~many), F.lit(True)).alias("small")).first()
    parts = [_ranked(rows, by, names, targets.filter(~many))] if kinds["small"] else []
    parts += [_bracketed(rows, by, names, targets.filter(many))] if kinds["large"] else []
    return reduce(DataFrame.unionByName, parts)


def _with(rows: DataFrame, by: Sequence[str], table: DataFrame) -> DataFrame:
    """Rows of the groups in a staged table, with its other columns. Without groups that table has one row."""
    if by:
        return join_heavy_apart(rows, table, by)
    return rows.withColumns({c: table.select(c).scalar() for c in table.columns})


def _ranked(rows: DataFrame, by: Sequence[str], names: Sequence[str], targets: DataFrame) -> DataFrame:
    """Keys at their ranks in groups of few rows, by running totals over distinct keys."""
    distinct = _with(rows, by, targets.select(*by, *names)).groupBy(*by, "_key", *names).agg(F.sum("_n").alias("_n"))
    end = F.sum("_n").over(Window.partitionBy(*by).orderBy("_key").rowsBetween(Window.unboundedPreceding, 0))
    at = {n: (F.col(n) < F.col("_end")) & (F.col(n) >= F.col("_end") - F.col("_n")) for n in names}
    return distinct.withColumn("_end", end).groupBy(*by).agg(*[F.max(F.when(hit, F.col("_key"))).alias(n) for n, hit in at.items()])


def _bracketed(rows: DataFrame, by: Sequence[str], names: Sequence[str], targets: DataFrame) -> DataFrame:
    """Keys at their ranks in groups of many rows."""
    share = F.col("_n") * F.lit(float(_SAMPLE)) / F.col("_total")
    picked = _with(rows, by, targets.select(*by, "_total")).filter(F.rand(1) < share)
    times = F.greatest(F.round(share), F.lit(1)).cast("int")  # a key that stands for many rows counts several times
    keys = picked.groupBy(*by).agg(F.sort_array(F.flatten(F.collect_list(F.array_repeat("_key", times)))).alias("_keys"))
    # written, as another evaluation could pick other rows
    sampled = _with(targets.select(*by, "_total", *names), by, stage(keys, "sampled"))
    bounds = stage(sampled.select(*by, *[c for n in names for c in (F.col(n), *_bounds(n))]), "brackets")

    lows = {n: f"_low_{n}" for n in names}
    within = {n: _within(n) for n in names}
    below = [F.sum(F.when(F.col("_key") < F.col(low), F.col("_n")).otherwise(0)).alias(f"_below_{n}") for n, low in lows.items()]
    inside = F.when(reduce(lambda x, y: x | y, within.values()), F.col("_key"))
    # a row per distinct key inside a bracket, and one per group for all other keys
    counted = _with(rows, by, bounds).groupBy(*by, inside.alias("_key")).agg(F.sum("_n").alias("_n"), *below)
    counted = stage(counted, "counted")

    tag = f"_name{len(by)}"  # a bracket inside a bracket has two
    each = [*by, tag]
    known = _with(counted.select(*by, "_key", "_n").filter("_key is not null"), by, bounds)
    held = reduce(DataFrame.unionAll, [known.filter(hit).select(*by, F.lit(n).alias(tag), "_key", "_n") for n, hit in within.items()])
    sums = _with(counted.groupBy(*by).agg(*[F.sum(f"_below_{n}").alias(f"_below_{n}") for n in names]), by, bounds)
    asked = [F.struct(F.lit(n).alias(tag), F.col(n).alias("_at"), F.col(f"_below_{n}").alias("_below"), F.col(low).alias("_low"), F.col(f"_high_{n}").alias("_high")) for n, low in lows.items()]
    asked = sums.select(*by, F.explode(F.array(*asked)).alias("_t")).select(*by, "_t.*").filter("_at is not null")
    counts = held.groupBy(*each).agg(F.sum("_n").alias("_inside"))
    asked = stage(join_null_safe(asked, counts, each, "left").fillna(0, ["_inside"]), "asked")

    rank = F.col("_at") - F.col("_below")
    hit = (rank >= 0) & (rank < F.col("_inside"))
    parts = [_at_one(held, each, asked.filter(hit).select(*each, rank.alias("_at")))]
    for missed in asked.filter(~hit).select(tag).distinct().collect():  # of the few names
        own = asked.filter(~hit & (F.col(tag) == missed[tag]))
        beyond = _with(rows, by, own.select(*by, "_low", "_high", (rank < 0).alias("_left")))
        beyond = beyond.filter(F.when(F.col("_left"), F.col("_key") < F.col("_low")).otherwise(F.col("_key") > F.col("_high")))
        beyond = beyond.select(*by, F.lit(missed[tag]).alias(tag), "_key", "_n")
        parts.append(_at_one(beyond, each, own.select(*each, F.when(rank < 0, F.col("_at")).otherwise(rank - F.col("_inside")).alias("_at"))))
    found = reduce(DataFrame.unionByName, parts)
    found = found.groupBy(*by).agg(*[F.max(F.when(F.col(tag) == n, F.col("_at"))).alias(n) for n in names])
    return join_null_safe(targets.select(*by), found, by, "left") if by else found


def _at_one(rows: DataFrame, each: Sequence[str], asked: DataFrame) -> DataFrame:
    return _keys_at(rows, each, ["_at"], lambda sizes: join_null_safe(sizes, asked, each))


def _bounds(name: str) -> tuple[Column, Column]:
    """The sampled keys some standard errors below and above a rank; NULL where the sample does not reach so far."""
    n, share = F.size("_keys"), F.col(name) / F.col("_total")
    off = F.lit(_ERRORS) * F.sqrt(n * share * (1 - share)) + 1
    low, high = F.floor(n * share - off).cast("int"), F.ceil(n * share + off).cast("int")
    return F.get("_keys", low).alias(f"_low_{name}"), F.get("_keys", high).alias(f"_high_{name}")


def _within(name: str) -> Column:
    low, high, key = F.col(f"_low_{name}"), F.col(f"_high_{name}"), F.col("_key")
    return F.col(name).isNotNull() & (low.isNull() | (key >= low)) & (high.isNull() | (key <= high))


def hash_cuts(
    df: DataFrame,
    key_by: Sequence[str],
    seed: int | str,
    ranks: Ranks,
    group_by: Sequence[str] = (),
    method: str = "xxhash64",
) -> DataFrame:
    """Like :func:`range_cuts` in hash order, without sorting the keys.

    Counting rows per group and hash prefix tells which chunk holds each rank; only the rows of
    those few chunks are ranked.
    """
    hashed = df.select(*group_by, *key_by, hash_of(key_by, seed, method).alias("_hash"))
    hashed = hashed.withColumn("_chunk", chunk_of("_hash", _CUT_DIGITS, method))
    group = Window.partitionBy(*group_by)
    upto = group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    sizes = hashed.groupBy(*group_by, "_chunk").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumns({"_end": F.sum("_n").over(upto), "_total": F.sum("_n").over(group)})
    start = F.col("_end") - F.col("_n")
    hit = F.lit(False)
    for rank in ranks.values():
        r = rank(F.col("_total"))
        hit = hit | ((r >= start) & (r < F.col("_end")))
    # one chunk of every group is kept so that the group's size survives when no rank falls inside it
    chunks = sizes.filter(hit | (start == 0)).select(*group_by, "_chunk", start.alias("_start"), "_total")
    chunks = stage(chunks, "chunks")
    inside = Window.partitionBy(*group_by, "_chunk").orderBy("_hash", *key_by)
    keys = join_null_safe(hashed, chunks, [*group_by, "_chunk"])
    keys = keys.withColumn("_pos", F.col("_start") + F.row_number().over(inside) - 1)
    return _cuts_at(keys, key_of("_hash", *key_by), ranks, group_by)


def _cuts_at(keys: DataFrame, key: Column, ranks: Ranks, group_by: Sequence[str]) -> DataFrame:
    found = {name: F.max(F.when(F.col("_pos") == rank(F.col("_total")), key)) for name, rank in ranks.items()}
    cuts = keys.groupBy(*group_by).agg(*[c.alias(name) for name, c in found.items()])
    # Written, so that Spark knows its size and broadcasts it only while it is small.
    return stage(cuts, "cuts")


def attach_cuts(
    df: DataFrame, cuts: DataFrame, names: Sequence[str], group_by: Sequence[str]
) -> tuple[DataFrame, dict[str, Column]]:
    """Make the cuts of each row's group available as columns: a join, or a scalar subquery without groups."""
    if group_by:
        return join_heavy_apart(df, cuts, group_by), {name: F.col(name) for name in names}
    return df, {name: cuts.select(name).scalar() for name in names}


def reaches(key: Column, cut: Column) -> Column:
    """Whether a key lies at or past a cut. NULL, which no ``when`` takes, if the cut is past the end."""
    return key >= cut

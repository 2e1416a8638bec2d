"""Splits, batches, ids, previews and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom import constants as C
from labelloom.operators.cuts import Ranks, attach_cuts, hash_cuts, key_of, range_cuts, reaches
from labelloom.operators.positions import hash_of, permuted, with_hash_positions


def _share(n: Column, fraction: float) -> Column:
    return F.floor(n.cast("double") * F.lit(fraction))


def _split_ranks(train: float, val: float) -> Ranks:
    return {
        "_val_from": lambda n: _share(n, train),
        "_test_from": lambda n: _share(n, train) + _share(n, val),
    }


def _label(df: DataFrame, cuts: DataFrame, key: Column, group_by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    with_cuts, cut = attach_cuts(df, cuts, ["_val_from", "_test_from"], group_by)
    split = F.when(reaches(key, cut["_test_from"]), "test").when(reaches(key, cut["_val_from"]), "val").otherwise("train")
    return with_cuts.withColumn("split", split).select(*columns, "split")


def split_ordered(
    df: DataFrame, order_by: Sequence[str], train: float = C.TRAIN_FRACTION, val: float = C.VAL_FRACTION
) -> DataFrame:
    """Add ``split``: the first share of the rows in key order is train, the next val, the rest test.

    Rows with equal keys go to one split, so shares are exact only if ``order_by`` tells rows apart: add a column that does.
    """
    cuts = range_cuts(df, order_by, _split_ranks(train, val))
    return _label(df, cuts, key_of(*order_by), (), df.columns)


def split_positions(
    df: DataFrame, pos: str = "pos", total: str = "pos_total", train: float = C.TRAIN_FRACTION, val: float = C.VAL_FRACTION
) -> DataFrame:
    """Like :func:`split_ordered` for rows that know their position and the number of rows: arithmetic alone.

    ``pos`` becomes the position inside the split; ``total`` is dropped.
    """
    ranks = _split_ranks(train, val)
    val_from, test_from = (ranks[n](F.col(total)) for n in ("_val_from", "_test_from"))
    split = F.when(F.col(pos) >= test_from, "test").when(F.col(pos) >= val_from, "val").otherwise("train")
    first = F.when(F.col(pos) >= test_from, test_from).when(F.col(pos) >= val_from, val_from).otherwise(0)
    return df.withColumns({"split": split, pos: F.col(pos) - first}).drop(total)


def split_stratified(
    df: DataFrame,
    key_by: Sequence[str],
    strata: Sequence[str],
    seed: int = 0,
    train: float = C.TRAIN_FRACTION,
    val: float = C.VAL_FRACTION,
    method: str = "xxhash64",
) -> DataFrame:
    """Add ``split`` with the same shares inside every stratum, rows taken in hash order of their key."""
    cuts = hash_cuts(df, key_by, seed, _split_ranks(train, val), strata, method)
    return _label(df, cuts, key_of(hash_of(key_by, seed, method).alias("_hash"), *key_by), strata, df.columns)


def tail_holdout(
    df: DataFrame,
    order_by: Sequence[str],
    fraction: float = C.HOLDOUT_FRACTION,
    exclude_from_train: bool = False,
) -> DataFrame:
    """Rows with ``split``: the last share in key order is test. Rows with equal keys stay together.

    By default the train part keeps those rows too, so they appear once per split.
    """
    cuts = range_cuts(df, order_by, {"_tail_from": lambda n: n - _share(n, fraction)})
    _, cut = attach_cuts(df, cuts, ["_tail_from"], ())
    in_tail = reaches(key_of(*order_by), cut["_tail_from"])
    tail = ["test"] if exclude_from_train else ["train", "test"]
    splits = F.when(in_tail, F.array(*[F.lit(s) for s in tail])).otherwise(F.array(F.lit("train")))
    return df.select("*", F.explode(splits).alias("split"))


def shuffle_into_batches(
    df: DataFrame,
    key_by: Sequence[str],
    batch_size: int = C.BATCH_SIZE,
    seed: int = 0,
    epoch: int = 0,
    method: str = "xxhash64",
) -> DataFrame:
    """Add ``pos`` and ``batch``: rows in a random order that is fixed by seed and epoch."""
    shuffled = with_hash_positions(df, key_by, f"{seed}-{epoch}", method=method)
    return in_batches(shuffled, batch_size)


def epoch_batches(
    df: DataFrame,
    batch_size: int = C.BATCH_SIZE,
    seed: int = 0,
    epoch: int = 0,
    n: int | None = None,
    method: str = "xxhash64",
) -> DataFrame:
    """Add ``place`` and ``batch`` to rows that have dense positions ``pos``: the order of one epoch, without a shuffle.

    Positions are found once; the order of every further epoch is arithmetic on them, see
    :func:`labelloom.operators.positions.permuted`. ``n``, the number of rows, is read from the positions where it is not given.
    """
    if n is None:
        n = (df.agg(F.max("pos")).first()[0] or 0) + 1
    placed = df.withColumn("place", permuted(F.col("pos"), n, f"{seed}-{epoch}", method))
    return placed.withColumn("batch", F.expr(f"place div {batch_size}"))


def in_batches(df: DataFrame, batch_size: int = C.BATCH_SIZE) -> DataFrame:
    """Add ``batch`` to rows that have ``pos``; the last batch may be short."""
    return df.withColumn("batch", F.expr(f"pos div {batch_size}"))


def assign_ids(df: DataFrame, pos: str = "pos", split: str | None = "split") -> DataFrame:
    """Add ``id``: a number that starts at 10000 in each split, then three letters taken from a hash."""
    parts = [F.col(c).cast("string") for c in ([split] if split else []) + [pos]]
    digits = F.md5(F.concat_ws("-", *parts))
    letters = []
    for start in (1, 5, 9):
        number = F.conv(F.substring(digits, start, 4), 16, 10).cast("int")
        letters.append(F.char(F.lit(65) + number % 26))
    number = (F.lit(C.FIRST_ID) + F.col(pos)).cast("string")
    return df.withColumn("id", F.concat(number, *letters))


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in key order."""
    return df.orderBy(*order_by).limit(n)


def profile_splits(df: DataFrame) -> DataFrame:
    """Rows and columns of every split."""
    columns = len([c for c in df.columns if c != "split"])
    return df.groupBy("split").agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(columns))

"""Text files whose lines belong together by position."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import text as T
from labelloom.operators.positions import file_columns, with_file_positions, with_positions


def read_text(spark: SparkSession, path: str) -> DataFrame | None:
    """Lines of a text file, or None when it does not exist. Bytes that are not UTF-8 become U+FFFD."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return lines.select(F.make_valid_utf8("value").alias("value"), *[c.alias(n) for n, c in file_columns().items()])


def _positioned_lines(lines: DataFrame) -> DataFrame:
    """Stripped lines without the blank ones, with their position and the number of lines."""
    kept = lines.withColumn("value", T.strip_text("value")).filter(F.col("value") != "")
    return with_file_positions(kept, total="pos_total")


def zip_by_position(left: DataFrame, right: DataFrame, total: str = "pos_total") -> DataFrame:
    """Pair rows of equal ``pos``, provided both sides have the same number of rows."""
    return left.join(right, ["pos", total])


def zip_tables(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Pair the rows of two tables by their position in key order; no rows when the counts differ."""
    numbered = [
        with_positions(df, order, total="pos_total") for df, order in ((left, left_order), (right, right_order))
    ]
    return zip_by_position(*numbered).drop("pos_total")


def read_aligned_lines(
    spark: SparkSession, folder: str, files: dict[str, str], splits: Sequence[str] = ("train", "val", "test")
) -> tuple[DataFrame, DataFrame]:
    """Zip the files of each split folder line by line, after blank lines are removed from each.

    Returns the rows ``(split, pos, <columns>)`` and one status row per split: ``ok``,
    ``missing_file``, ``count_mismatch`` or ``empty``, with the smallest and largest line count. Splits that are
    not ``ok`` give no rows.
    """
    names = list(files)
    zipped, statuses = [], []
    for split in splits:
        found = {c: read_text(spark, f"{folder}/{split}/{name}") for c, name in files.items()}
        if any(lines is None for lines in found.values()):
            statuses.append(spark.createDataFrame([(split, "missing_file", None, None)], _STATUS))
            continue
        parts = {c: _positioned_lines(lines).withColumnRenamed("value", c) for c, lines in found.items()}
        counts = reduce(
            DataFrame.unionByName, [part.agg(F.count("*").alias("n")) for part in parts.values()]
        ).agg(F.min("n").alias("least"), F.max("n").alias("most"))
        status = (
            F.when(F.col("least") != F.col("most"), "count_mismatch").when(F.col("most") == 0, "empty").otherwise("ok")
        )
        statuses.append(counts.select(F.lit(split).alias("split"), status.alias("status"), "least", "most"))
        rows = reduce(zip_by_position, parts.values())
        zipped.append(rows.select(F.lit(split).alias("split"), "pos", *names))
    empty = spark.createDataFrame([], ", ".join(["split string", "pos bigint", *[f"`{c}` string" for c in names]]))
    return reduce(DataFrame.unionByName, zipped, empty), reduce(DataFrame.unionByName, statuses)


_STATUS = "split string, status string, least bigint, most bigint"


def read_unquoted(spark: SparkSession, path: str, columns: Sequence[str] = ("sentence", "sentiment")) -> DataFrame:
    """Rows of lines made by ``encode_unquoted``. Lines with too many fields are dropped, missing fields are NULL."""
    return unquoted_rows(spark.read.text(path), columns)


def unquoted_rows(lines: DataFrame, columns: Sequence[str] = ("sentence", "sentiment")) -> DataFrame:
    """Fields of the lines in column ``value``, for :func:`read_unquoted`."""
    fields = lines.select(T.decode_unquoted("value").alias("_fields"))
    fitting = fields.filter(F.size("_fields") <= len(columns))
    return fitting.select(*[F.get("_fields", F.lit(i)).alias(c) for i, c in enumerate(columns)])

"""Readers of untidy CSV files.

Two dialects are known: ``quoted`` doubles a quote inside quotes, ``escaped`` puts a backslash
before it. The lenient reader also knows ``unquoted``: lines with backslashes and without quotes, as
``write_unquoted`` makes them. Large files are read by many tasks, whether or not there are line
breaks inside quotes, see :mod:`labelloom.sources.records`; ``multi_line=False`` says that there are none.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.labels import parse_label
from labelloom.operators.joins import broadcast_if_small
from labelloom.operators.tables import ensure_column
from labelloom.sources.records import Records, columns
from labelloom.staging import stage

SENTENCE_COLUMNS = ("sentence", "sentiment")


def read_csv_lenient(
    spark: SparkSession, path: str, dialect: str = "escaped", multi_line: bool = True, positions: bool = False
) -> DataFrame | None:
    """Rows ``(sentence, sentiment)``: rows with too many fields are dropped, missing fields are NULL.

    Returns None when there is no such file. ``positions`` adds ``pos``, the place of the row in its file or folder
    of part files, from 0; dropped rows leave gaps.
    """
    try:
        records = Records(spark, path, dialect, multi_line)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    rows = records.rows().filter(F.size("fields") <= len(SENTENCE_COLUMNS))
    return rows.select(*columns(SENTENCE_COLUMNS), *(["pos"] if positions else []))


def read_csv_dir(
    spark: SparkSession, path: str, dialect: str = "quoted", multi_line: bool = True, positions: bool = False
) -> DataFrame:
    """The first two columns, by position, of every CSV file of a folder or glob, with ``source_file``.

    Each file's own header is skipped. Files whose header has fewer than two columns are ignored. ``positions`` adds
    ``pos``: rows of all files are counted in order of folder, part number and name; ignored files leave gaps.
    """
    records = Records(spark, path, dialect, multi_line, "*.csv")
    # Written, so that Spark knows its size: one row per file.
    wide = stage(records.headers().filter(F.size("fields") >= 2).select("_file"), "headers")
    rows = records.rows().join(broadcast_if_small(wide), "_file", "left_semi")
    return rows.select(*columns(SENTENCE_COLUMNS), "source_file", *(["pos"] if positions else []))


def read_raw_rows(spark: SparkSession, path: str, dialect: str = "quoted", multi_line: bool = True) -> DataFrame:
    """Rows ``(pos, text, label)`` with at least two fields; further fields are ignored.

    ``pos`` counts all rows of the file, also the skipped ones. Bytes that are not UTF-8 become U+FFFD,
    an empty field stays empty text. The label is still text: see ``parse_label``.
    """
    rows = Records(spark, path, dialect, multi_line).rows().filter(F.size("fields") >= 2)
    text, label = columns(("text", "label"))
    return rows.select("pos", F.coalesce(text, F.lit("")).alias("text"), F.coalesce(label, F.lit("")).alias("label"))


def read_splits(spark: SparkSession, folder: str, dialect: str = "quoted", multi_line: bool = True) -> DataFrame:
    """Rows ``(split, id, text, class)`` of ``train.csv``, ``val.csv`` and ``test.csv``.

    A missing test file gives no rows, a missing train or val file is an error. A test file without
    ``class`` gets the default label.
    """
    parts = []
    for split in ("train", "val", "test"):
        try:
            records = Records(spark, f"{folder}/{split}.csv", dialect, multi_line)
        except AnalysisException:
            if split != "test":
                raise
            rows = spark.createDataFrame([], "id string, text string, class string")
        else:
            header = records.headers().orderBy("_file").first()  # the part files of a split have equal headers
            names = list(header["fields"]) if header else ["id", "text", "class"]
            rows = records.rows().select(*columns(names))
        if split == "test":
            rows = ensure_column(rows)
        label = F.col("class").try_cast("int").alias("class")
        parts.append(rows.select(F.lit(split).alias("split"), "id", "text", label))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def with_parsed_label(raw: DataFrame) -> DataFrame:
    """Raw rows with the label as ``class``, the default where it is no integer."""
    return raw.withColumn("class", parse_label("label")).drop("label")

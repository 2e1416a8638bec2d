"""Writers. Parquet is the form that stages pass on; CSV and plain lines are for the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelloom.functions import text as T
from labelloom.staging import hadoop_path


# Header, doubled quotes, and texts as they are: white space at the ends is kept, empty stays empty.
_CSV = {
    "header": True,
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_csv(df: DataFrame, path: str) -> None:
    """Write all columns as CSV with header, quoted only where needed."""
    df.write.options(**_CSV).csv(path)


def write_plain(df: DataFrame, path: str) -> None:
    """Write the one text column as lines below a header line that is its name."""
    unused = {"sep": "\x01", "quote": ""}
    df.write.options(**{**_CSV, **unused}).csv(path)


def write_corpus(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write ``sentence, sentiment`` with one folder per split, as Parquet or as CSV with header."""
    writer = df.select("split", "sentence", "sentiment").write.partitionBy("split")
    if form == "csv":
        writer.options(**_CSV).csv(path)
    else:
        writer.parquet(path)


def write_final_csv(df: DataFrame, path: str) -> None:
    """Write ``id, text, class`` as CSV with header and quotes only where needed."""
    write_csv(df.select("id", "text", "class"), path)


def write_unquoted(df: DataFrame, path: str, *columns: str, header: bool = False) -> None:
    """Write lines without quotes, which ``read_unquoted``, or with a header ``read_csv_lenient``, reads back."""
    lines = df.select(T.encode_unquoted(*columns).alias(",".join(columns)))
    if header:
        write_plain(lines, path)
    else:
        lines.write.text(path)


def append_with_header(df: DataFrame, path: str) -> None:
    """Append rows to a Parquet table, made on first use; its schema stands for the header."""
    df.write.mode("append").parquet(path)


append_batches = append_with_header


def _versions(spark: SparkSession, path: str) -> dict[int, bool]:
    """The version folders of a table, and whether each is complete."""
    found, files = hadoop_path(spark, path)
    if not files.exists(found):
        return {}
    versions = {}
    for status in files.listStatus(found):
        name, _, number = status.getPath().getName().partition("=")
        if name == "version" and number.isdigit():
            versions[int(number)] = files.exists(hadoop_path(spark, f"{path}/version={number}/_SUCCESS")[0])
    return versions


def rewrite_safely(df: DataFrame, path: str, version: int) -> str:
    """Write the next version of a table beside the old ones and return where it is.

    ``df`` may read from an older version: nothing complete is touched. What a failed attempt has left of
    this version is replaced.
    """
    target = f"{path}/version={version}"
    broken = _versions(df.sparkSession, path).get(version) is False
    df.write.mode("overwrite" if broken else "errorifexists").parquet(target)
    return target


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a table written by :func:`rewrite_safely`. Others are not read."""
    complete = [version for version, done in _versions(spark, path).items() if done]
    if not complete:
        raise FileNotFoundError(f"no complete version below {path}")
    return spark.read.parquet(f"{path}/version={max(complete)}")

"""What the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import io
import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows sent to Python together. Texts are long, and a batch is held several times over on its way.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it.

    Also lowers the session's batch size for Python to ``BATCH_ROWS`` where it is larger.
    """
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, str(file.relative_to(package.parent)))
    path = os.path.join(tempfile.mkdtemp(prefix="labelloom-code-"), "labelloom_code.zip")
    Path(path).write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def whole_text(docs: DataFrame, text: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that other columns, however named, cannot clash with its own."""
    return docs.select(docs[id_col].alias("doc_id"), whole_text(docs, text).alias("text"))


def free_unused() -> None:
    """Give memory that a worker no longer uses back to the system: workers live on, beside each other, for later tasks.

    For the end of a batch; where the C library has no such call, only Arrow's memory is given back.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

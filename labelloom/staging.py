"""Tables written once to the shared folder, so that later steps re-read rows instead of recomputing them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "spark.checkpoint.dir"
_recorded: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the cluster; a temporary one is made only for a local master without that setting."""
    folder = spark.conf.get(_FOLDER, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_FOLDER} to a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="labelloom-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    path = f"{shared_folder(spark)}/labelloom/{name}-{uuid.uuid4().hex}"
    for paths in _recorded:
        paths.append(path)
    return path


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, for the few things that Spark's readers and writers cannot do."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all: written aside, then renamed."""
    target, files = hadoop_path(spark, path)
    aside, _ = hadoop_path(spark, f"{path}.{uuid.uuid4().hex}")
    out = files.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(target, False)
    if not files.rename(aside, target):
        raise OSError(f"cannot write {path}")


def read_file(spark: SparkSession, path: str) -> str | None:
    """A small file, or None when there is none."""
    found, files = hadoop_path(spark, path)
    if not files.exists(found) or files.getFileStatus(found).isDirectory():
        return None
    stream = files.open(found)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def list_folder(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """Name of each entry of a folder and whether it is a folder; none when there is no such folder."""
    found, files = hadoop_path(spark, path)
    if not files.exists(found):
        return []
    return sorted((entry.getPath().getName(), entry.isDirectory()) for entry in files.listStatus(found))


@contextmanager
def dropping_staged(spark: SparkSession) -> Iterator[None]:
    """Delete at the end whatever this block has staged. Nothing lazy made inside may be used later."""
    paths: list[str] = []
    _recorded.append(paths)
    try:
        yield
    finally:
        _recorded.remove(paths)
        for path in paths:
            found, files = hadoop_path(spark, path)
            files.delete(found, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and return a reader of it. The files stay: readers are lazy."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

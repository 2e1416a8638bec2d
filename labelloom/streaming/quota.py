"""Arriving responses, parsed and accepted until every category is full."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelloom import constants as C
from labelloom.operators.generated import parse_generated_lines
from labelloom.operators.quota import KEYS, accept_to_quota, progress, remaining_quota
from labelloom.staging import dropping_staged, hadoop_path, list_folder, read_file, stage, write_file


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that a checkpoint belongs to, made with it. A new checkpoint counts batches from 0 again."""
    path = f"{checkpoint}/labelloom-run.txt"
    if read_file(spark, path) is None:
        write_file(spark, path, uuid.uuid4().hex)
    return read_file(spark, path)


class _Ledger:
    """How many rows of each category are stored below a sink, kept beside its rows in ``_counts``.

    Each micro-batch leaves one snapshot: the counts of all rows so far, and what they cover, that is the last counted
    batch of every run and the names of files that no run wrote. The next one reads that snapshot and only rows that it
    does not cover: of other runs, and of plain appends. Rows taken away later still count.
    """

    def __init__(self, spark: SparkSession, sink: str, run: str, keys: Sequence[str]) -> None:
        self.spark, self.sink, self.run, self.keys = spark, sink, run, list(keys)
        self.base = f"{sink}/_counts/run={run}"

    def _snapshots(self) -> list[int]:
        return sorted(int(name.removeprefix("upto=")) for name, folder in list_folder(self.spark, self.base) if folder)

    def _covered(self, batch_id: int) -> tuple[str | None, dict]:
        """The folder of the last whole snapshot before a batch, and what it covers."""
        for known in reversed([b for b in self._snapshots() if b < batch_id]):
            folder = f"{self.base}/upto={known}"
            if (said := read_file(self.spark, f"{folder}/covered.json")) is not None:
                return folder, json.loads(said)
        return None, {"runs": {}, "files": []}

    def _plain_files(self, folder: str = "") -> list[str]:
        found = []
        for name, is_folder in list_folder(self.spark, f"{self.sink}/{folder}"):
            if name.startswith(("_", ".")) or (not folder and name.startswith("run=")):
                continue
            found += self._plain_files(f"{folder}{name}/") if is_folder else [f"{folder}{name}"]
        return found

    def uncovered(self, batch_id: int, covered: dict) -> tuple[list[str], dict]:
        """Paths of stored rows that are not covered, without those of this batch and later ones of this run, and what is
        covered with them."""
        runs, paths = dict(covered["runs"]), []
        for name, is_folder in list_folder(self.spark, self.sink):
            run = name.removeprefix("run=")
            if not is_folder or run == name:
                continue
            last = runs.get(run, -1)
            for batch, _ in list_folder(self.spark, f"{self.sink}/{name}"):
                number = int(batch.removeprefix("batch_id=")) if batch.startswith("batch_id=") else -1
                if number > last and (run != self.run or number < batch_id):
                    paths.append(f"{self.sink}/{name}/{batch}")
                    runs[run] = max(runs.get(run, -1), number)
        files = sorted(set(self._plain_files()).difference(covered["files"]))
        return paths + [f"{self.sink}/{f}" for f in files], {"runs": runs, "files": sorted({*covered["files"], *files})}

    def before(self, batch_id: int, categories: DataFrame) -> tuple[DataFrame, dict]:
        """Stored rows per category before a batch, and what they cover."""
        folder, covered = self._covered(batch_id)
        paths, covered = self.uncovered(batch_id, covered)
        parts = [self.spark.read.parquet(f"{folder}/counts")] if folder else []
        if paths:
            rows = self.spark.read.option("recursiveFileLookup", True).parquet(*paths)
            parts.append(progress(rows, self.keys))
        if not parts:
            return progress(categories.limit(0), self.keys), covered
        return reduce(DataFrame.unionByName, parts).groupBy(*self.keys).agg(F.sum("n").alias("n")), covered

    def keep(self, batch_id: int, counts: DataFrame, covered: dict) -> None:
        """Write the snapshot of a batch whose rows are stored, and drop those that no repeated batch can need."""
        folder = f"{self.base}/upto={batch_id}"
        covered = covered | {"runs": covered["runs"] | {self.run: batch_id}}
        counts.coalesce(1).write.mode("overwrite").parquet(f"{folder}/counts")
        write_file(self.spark, f"{folder}/covered.json", json.dumps(covered))
        for old in self._snapshots():
            if old < batch_id - 1:
                path, files = hadoop_path(self.spark, f"{self.base}/upto={old}")
                files.delete(path, True)


def stream_accept_rows(
    rows: DataFrame,
    categories: DataFrame,
    sink: str,
    checkpoint: str,
    arrival: Sequence[str],
    target: int = C.TARGET_PER_CATEGORY,
    keys: Sequence[str] = KEYS,
    **trigger: object,
) -> StreamingQuery:
    """Write the first ``target`` rows of each category to ``sink``, over all micro-batches, restarts and runs.

    Each micro-batch knows what is stored from the counts that the one before it left, and counts rows written by
    others since, so full categories are dropped before any shuffle and what is read does not grow with the number of
    micro-batches. It owns the folder of its run and number and replaces it, and its counts, when it is run again
    after a failure; one that accepts nothing leaves no rows. Arrived rows are staged and deleted in the end.
    """
    spark = categories.sparkSession
    ledger = _Ledger(spark, sink, _run_of(spark, checkpoint), keys)

    def accept(batch: DataFrame, batch_id: int) -> None:
        with dropping_staged(spark):
            arrived = stage(batch, "arrived")
            done, covered = ledger.before(batch_id, categories)
            done = stage(done, "done")
            folder = f"{sink}/run={ledger.run}/batch_id={batch_id}"
            accepted = accept_to_quota(arrived, remaining_quota(categories, done, target, keys), arrival, keys)
            accepted.write.mode("overwrite").parquet(folder)
            new = progress(spark.read.schema(accepted.schema).parquet(folder), keys)
            if new.isEmpty():
                path, files = hadoop_path(spark, folder)
                files.delete(path, True)
                new = new.limit(0)
            ledger.keep(batch_id, stage(done.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n")), "counts"), covered)

    writer = rows.writeStream.foreachBatch(accept).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_accept_to_quota(
    responses: DataFrame,
    categories: DataFrame,
    sink: str,
    checkpoint: str,
    arrival: Sequence[str],
    target: int = C.TARGET_PER_CATEGORY,
    **trigger: object,
) -> StreamingQuery:
    """Like :func:`stream_accept_rows` for responses that still have to be parsed into lines."""
    lines = parse_generated_lines(responses, keep=[*KEYS, *arrival])
    return stream_accept_rows(lines, categories, sink, checkpoint, [*arrival, "line_no"], target, **trigger)

"""Streams against their batch forms, over several micro-batches and restarts."""

from __future__ import annotations

import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from labelloom.operators.quota import progress
from labelloom.plans.queries import answered_requests, letter_model, stream_quota, stream_scores
from labelloom.plans.scoring import answer_requests
from labelloom.sources.sinks import append_with_header
from labelloom.staging import shared_folder
from labelloom.streaming import quota
from labelloom.streaming.quota import stream_accept_to_quota
from labelloom.streaming.scoring import stream_score

SENTENCE = "câu này đủ dài để được giữ lại trong tập dữ liệu cuối cùng"
SCHEMA = "category string, label int, no int, response string"


def add_file(spark, folder, numbers):
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(i.cast("string"), F.lit(f" {SENTENCE},2"))), "\n")
    rows = spark.createDataFrame([("hot", 2, n) for n in numbers] + [("rare", 2, n) for n in numbers[:1]], "category string, label int, no int")
    rows.withColumn("response", lines).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture()
def folders(tmp_path):
    return {name: str(tmp_path / name) for name in ("in", "sink", "checkpoint")}


def run(spark, folders, target=150):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folders["in"])
    categories = spark.createDataFrame([("hot", 2), ("rare", 2), ("absent", 0)], "category string, label int")
    query = stream_accept_to_quota(stream, categories, folders["sink"], folders["checkpoint"], ["no"], target)
    query.awaitTermination()
    return spark.read.parquet(folders["sink"])


def test_quota_over_batches_and_restarts(spark, folders):
    add_file(spark, folders["in"], [4, 3, 2, 1, 0])
    add_file(spark, folders["in"], [5, 6, 7, 8, 9])
    rows = run(spark, folders)
    assert {r.category: r.n for r in progress(rows).collect()} == {"hot": 150, "rare": 40}
    assert rows.select("batch_id").distinct().count() >= 2
    add_file(spark, folders["in"], [10, 11])
    rows = run(spark, folders)
    assert {r.category: r.n for r in progress(rows).collect()} == {"hot": 150, "rare": 60}
    hot = rows.filter("category = 'hot'").collect()
    assert len({(r.no, r.line_no) for r in hot}) == 150
    assert {r.no for r in hot} <= set(range(10))
    assert all(r.sentence.endswith(SENTENCE) and r.sentiment == 2 for r in hot)


def test_a_repeated_batch_replaces_its_rows(spark, folders):
    """The same batch run twice, as after a failure between the write and the commit."""
    add_file(spark, folders["in"], [0, 1, 2])
    rows = run(spark, folders, 25)
    before = sorted((r.category, r.no, r.line_no) for r in rows.collect())
    for name in ("commits", "offsets"):  # the batch is planned, run and committed anew
        shutil.rmtree(f"{folders['checkpoint']}/{name}")
    shutil.rmtree(f"{folders['checkpoint']}/sources")
    after = sorted((r.category, r.no, r.line_no) for r in run(spark, folders, 25).collect())
    assert before == after and len(before) == 45


def test_a_new_run_and_plain_appends_count_and_stay(spark, folders):
    add_file(spark, folders["in"], [0])
    first = sorted((r.category, r.no, r.line_no) for r in run(spark, folders, 30).collect())
    assert len(first) == 40
    append_with_header(spark.createDataFrame([("rare", 2)] * 8, "category string, label int"), folders["sink"])
    other = dict(folders, checkpoint=folders["checkpoint"] + "-2", **{"in": folders["in"] + "-2"})
    add_file(spark, other["in"], [7, 8])
    stream = spark.readStream.schema(SCHEMA).parquet(other["in"])
    categories = spark.createDataFrame([("hot", 2), ("rare", 2)], "category string, label int")
    stream_accept_to_quota(stream, categories, other["sink"], other["checkpoint"], ["no"], 30).awaitTermination()
    rows = spark.read.options(recursiveFileLookup=True, mergeSchema=True).parquet(folders["sink"])
    assert {r.category: r.n for r in progress(rows).collect()} == {"hot": 30, "rare": 30}
    assert set(first) <= {(r.category, r.no, r.line_no) for r in rows.filter("no is not null").collect()}


def test_a_full_quota_writes_nothing_and_staged_tables_go(spark, folders):
    add_file(spark, folders["in"], [0])
    run(spark, folders, 5)
    staged = Path(shared_folder(spark).removeprefix("file:")) / "labelloom"
    before = set(staged.iterdir()), set(Path(folders["sink"]).rglob("batch_id=*"))
    add_file(spark, folders["in"], [1])
    run(spark, folders, 5)
    assert before == (set(staged.iterdir()), set(Path(folders["sink"]).rglob("batch_id=*")))


def test_reads_do_not_grow_with_earlier_batches(spark, folders, monkeypatch):
    """Every batch reads the one snapshot before it, and rows of others once."""
    read = []
    plain = quota._Ledger.uncovered
    monkeypatch.setattr(quota._Ledger, "uncovered", lambda *a: (read.append(plain(*a)), read[-1])[1])
    for n in range(8):
        add_file(spark, folders["in"], [n])
    rows = run(spark, folders, 1000)
    assert {r.category: r.n for r in progress(rows).collect()} == {"hot": 160, "rare": 160}
    append_with_header(spark.createDataFrame([("rare", 2)] * 8, "category string, label int"), folders["sink"])
    for n in range(8, 12):
        add_file(spark, folders["in"], [n])
    run(spark, folders, 230)
    assert [len(paths) for paths, _ in read] == [0] * 8 + [len(read[8][0])] + [0] * 3 and read[8][0]
    snapshots = sorted(p.name for p in Path(folders["sink"]).glob("_counts/run=*/upto=*"))
    assert snapshots == ["upto=10", "upto=11"]
    stored = spark.read.options(recursiveFileLookup=True).schema("category string, label int").parquet(folders["sink"])
    assert {r.category: r.n for r in progress(stored).collect()} == {"hot": 230, "rare": 230}


def test_a_snapshot_without_its_mark_is_not_used(spark, folders):
    """As after a failure in the middle: the rows of the batches are read again."""
    add_file(spark, folders["in"], [0])
    add_file(spark, folders["in"], [1])
    run(spark, folders, 100)
    for mark in Path(folders["sink"]).glob("_counts/run=*/upto=*/covered.json"):
        mark.unlink()
    add_file(spark, folders["in"], [2, 3, 4, 5])
    rows = run(spark, folders, 100)
    assert {r.category: r.n for r in progress(rows).collect()} == {"hot": 100, "rare": 60}


def test_scores(spark, folders):
    requests = spark.createDataFrame([(1, "aaa b"), (2, " \t"), (3, "iii e"), (4, None)], "k int, text string")
    requests.repartition(3).write.parquet(folders["in"])
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(folders["in"])
    stream_score(stream, letter_model(), folders["sink"], folders["checkpoint"]).awaitTermination()
    got = {r.k: r.response for r in spark.read.parquet(folders["sink"]).collect()}
    want = {r.k: r.response for r in answer_requests(requests, letter_model()).collect()}
    assert got == want
    assert json.loads(got[1])["data"] == {"classify": "Tiêu cực"}
    assert json.loads(got[2])["status"] == json.loads(got[4])["status"] == "error"


@pytest.mark.parametrize("files", [0, 3])
def test_queries_stream_a_table_that_is_a_file_or_a_folder(spark, tmp_path, files):
    """Beside other tables: 0 files stand for a table that is one file itself, more for a folder of that many."""
    said = spark.createDataFrame([(i, 0, "aaa b" if i % 2 else " ") for i in range(30)], "conv_id long, turn long, text string")
    kinds = F.element_at(F.array(*map(F.lit, ("click", "view"))), F.col("id").cast("int") % 2 + 1)
    events = spark.range(40).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), kinds.alias("event_type"), F.lit("{}").alias("props"))
    for name, rows in (("conversations", said), ("events", events), ("documents", said)):
        rows.repartition(max(files, 1)).write.parquet(folder := str(tmp_path / ("tables" if files else "parts") / f"{name}.parquet"))
        if not files:
            (tmp_path / "tables").mkdir(exist_ok=True)
            shutil.copy(next(Path(folder).glob("part-*")), tmp_path / "tables" / f"{name}.parquet")
    sf = str(tmp_path / "tables")
    got = sorted(tuple(r) for r in stream_scores(spark, sf).collect())
    assert len(got) == 30 and got == sorted(tuple(r) for r in answered_requests(spark, sf).collect())
    assert sorted(r.event_id for r in stream_quota(spark, sf).collect()) == list(range(40))

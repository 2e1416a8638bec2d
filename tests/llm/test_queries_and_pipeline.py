"""The registered queries against their SQL, and the pipeline's stages."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from labelloom.llm import bpe, neardup
from labelloom.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    assert rows or name == "op8_license_scans"
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        order = [df.columns.index(c) for c in columns]
        assert sorted([tuple(r[i] for i in order) for r in rows], key=repr) == sorted(cursor.fetchall(), key=repr)


def test_native_queries_run_without_python(spark):
    plan = QUERIES["op5_secret_scans"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, work in corpus_pipeline.STAGES:
        out = work(spark, docs, SF_DIR)
        if name == "best-fit packing":
            tokens = bpe.encode(docs, bpe.vocabulary_path()).selectExpr("sum(octet_length(ids) / 4 + 1)").first()[0]
            assert out.selectExpr("sum(length)").first()[0] == tokens
            assert out.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").count() == 0
            break
        rows = out.select(*columns).collect()
        assert 0 < len(rows) <= before
        before = len(rows)
        docs = spark.createDataFrame(rows, docs.schema)
        if name == "near-duplicates":
            assert neardup.near_duplicates(docs).filter("not kept").count() == 0
        if name == "secret scans":
            assert out.filter("n_chars <> length(text)").count() == 0


def test_pipeline_of_awkward_rows(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good, "en", "s", 1), (1, good, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, good + " end", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for name, work in corpus_pipeline.STAGES:
            table = work(spark, table, SF_DIR)
            found = [tuple(r) for r in table.collect()]
            table = spark.createDataFrame(found, table.schema)
            if name == "near-duplicates" and found:
                assert sorted(r[0] or 0 for r in found) in ([1], [0, 1])

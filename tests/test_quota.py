"""Lines out of responses, paraphrases, and quotas."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from labelloom import constants as C
from labelloom.operators import cuts, generated, paraphrase, quota
from labelloom.plans import corpus

LONG = "một câu, có dấu phẩy và đủ dài để được giữ lại trong tập"


def test_generated_lines(spark):
    def sized(n):
        return "x" * n

    response = "\n".join([
        f" {LONG},2",  # the blob is stripped, so this sentence starts without its space
        *[f"{sized(n)},2" for n in (49, 50, 100, 101)],
        f"{sized(60)},0",
        sized(60),
        f"{sized(61)}, 2\r",
        f' {sized(25)}"{sized(30)} ,2',
        "",
    ])
    df = spark.createDataFrame([("a", 2, response)], "k string, label int, response string")
    out = generated.parse_generated_lines(df, keep=["k"]).orderBy("line_no").collect()
    assert [(r.line_no, r.sentence, r.sentiment) for r in out] == [
        (0, LONG, 2), (2, sized(50), 2), (3, sized(100), 2), (7, sized(61), 2), (8, f" {sized(55)} ", 2),
    ]


def test_paraphrases(spark):
    rows = spark.createDataFrame(
        [(1, "train", "a", 0), (2, "val", "b", 1), (3, "test", "c", 2), (4, "test", "d", 9)],
        "k int, split string, sentence string, sentiment int",
    )
    asked = {r.k: r.prompt for r in paraphrase.render_paraphrase_requests(rows, ["k"]).collect()}
    assert set(asked) == {2, 3, 4}
    assert "cảm xúc trung lập" in asked[2] and "cảm xúc tích cực" in asked[3] and "cảm xúc trung lập" in asked[4]
    answers = spark.createDataFrame([(2, ' "hi" '), (4, None)], "k int, answer string")
    out = paraphrase.apply_paraphrases(rows, answers, ["k"]).orderBy("k").collect()
    assert [(r.sentence, r.sentiment) for r in out] == [("a", 0), ("hi", 1), ("c", 2), ("d", 9)]


def test_several_answers_multiply_no_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "k int, sentence string")
    answers = [(1, "y"), (1, "x"), (1, " "), (1, None), (2, " "), (2, None), (3, None), (3, None), (None, "z"), (9, "q")]
    out = paraphrase.apply_paraphrases(rows, spark.createDataFrame(answers, "k int, answer string"), ["k"])
    assert sorted((r.k or 0, r.sentence) for r in out.collect()) == [(0, "e"), (1, "x"), (1, "x"), (2, ""), (3, "d")]


def test_categories(spark):
    table = quota.category_table(spark).collect()
    assert len(table) == 19
    assert [sum(r.label == c for r in table) for c in (0, 1, 2)] == [9, 0, 10]
    assert C.TARGET_PER_CATEGORY * len(table) == 38000


@pytest.fixture(scope="module")
def arrivals(spark):
    """One category holds two thirds of all rows; arrival order is not the order of the rows."""
    k = F.col("id")
    category = F.when(k % 3 < 2, "hot").when(k % 5 == 0, "small").otherwise("full")
    return spark.range(6000).select(category.alias("category"), F.lit(1).alias("label"), (k * 7919 % 6007).alias("at"))


def expected(arrivals, remaining):
    rows = sorted((r.category, r["at"]) for r in arrivals.collect())
    out = []
    for category, n in remaining.items():
        out += [r for r in rows if r[0] == category][:n]
    return sorted(out)


@pytest.mark.parametrize("target", [3, 1500, 3999, 100000])
@pytest.mark.parametrize("ranked_rows", [100_000, 300])
def test_accept_to_quota(spark, arrivals, target, ranked_rows, monkeypatch):
    monkeypatch.setattr(cuts, "_RANKED_ROWS", ranked_rows)
    monkeypatch.setattr(cuts, "_SAMPLE", 150)
    categories = spark.createDataFrame([("hot", 1), ("small", 1), ("full", 1), ("absent", 1)], "category string, label int")
    done = spark.createDataFrame([("small", 1, 2), ("full", 1, 100000)], "category string, label int, n bigint")
    remaining = quota.remaining_quota(categories, done, target)
    want = {"hot": target, "small": max(target - 2, 0), "absent": target}
    assert {r.category: r.remaining for r in remaining.collect()} == want
    got = quota.accept_to_quota(arrivals, remaining, ["at"])
    assert got.columns == arrivals.columns
    assert sorted((r.category, r["at"]) for r in got.collect()) == expected(arrivals, want)
    assert quota.total_generated(categories, done).first().total == 100002


def test_quota_keeps_columns_of_any_name(spark):
    batch = spark.createDataFrame([("c", 0, i, i, "x") for i in range(5)], "category string, label int, _last int, remaining int, _key string")
    remaining = spark.createDataFrame([("c", 0, 2)], "category string, label int, remaining long")
    got = quota.accept_to_quota(batch, remaining, ["_last"])
    assert got.columns == batch.columns and sorted(r["_last"] for r in got.collect()) == [0, 1]


def test_first_arrival_is_kept(spark):
    batch = spark.createDataFrame([("c", 0, i) for i in (4, 2, 3, 1)], "category string, label int, at int")
    sink = spark.createDataFrame([("c", 0)] * 2, "category string, label int")
    categories = spark.createDataFrame([("c", 0)], "category string, label int")
    remaining = quota.remaining_quota(categories, quota.progress(sink), 3)
    assert [r["at"] for r in quota.accept_to_quota(batch, remaining, ["at"]).collect()] == [1]


def test_quota_follows_what_remains_and_null_arrives_first(spark):
    rows = spark.range(6000).selectExpr("if(id % 10 = 0, 'rare', 'hot') category", "0 label", "id at")
    remaining = spark.createDataFrame([("hot", 0, 5000)], "category string, label int, remaining long")
    assert quota.accept_to_quota(rows, remaining, ["at"]).count() == 5000
    batch = spark.createDataFrame([("c", 0, i) for i in (3, None, 1, 2)], "category string, label int, at int")
    for n, want in ((1, [None]), (3, [None, 1, 2]), (9, [None, 1, 2, 3])):
        remaining = spark.createDataFrame([("c", 0, n)], "category string, label int, remaining long")
        got = [r["at"] for r in quota.accept_to_quota(batch, remaining, ["at"]).collect()]
        assert sorted(got, key=lambda v: -1 if v is None else v) == want


def test_fill_categories_never_exceeds_the_target(spark):
    lines = "\n".join(f"{i:04d} {LONG},0" for i in range(30))
    asked = spark.createDataFrame([("c", 0, i, lines) for i in range(4)], "category string, label int, no int, response string")
    categories = spark.createDataFrame([("c", 0)], "category string, label int")
    first = corpus.fill_categories(asked, categories, None, ["no"], 50)
    rows = sorted((r.no, r.line_no) for r in first.collect())
    assert rows == [(0, i) for i in range(30)] + [(1, i) for i in range(20)]
    assert corpus.fill_categories(asked, categories, first, ["no"], 50).count() == 0
    assert corpus.fill_categories(asked, categories, first, ["no"], 60).count() == 10

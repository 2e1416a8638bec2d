"""Encoding, metrics, the classifier and the two plans around it."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelloom import constants as C
from labelloom.operators import classifier, features, metrics, tables
from labelloom.plans import corpus, scoring, training
from labelloom.streaming.scoring import stream_score


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, "b a"), (2, "A b, c c\tb"), (3, " "), (4, "zz " * 9)], "k int, text string")


def test_vocab(spark, texts):
    vocab = features.build_vocab(texts, 4)
    assert [tuple(r) for r in vocab.orderBy("id").collect()] == [("zz", 9, 4), ("a", 2, 5), ("b", 2, 6), ("c", 2, 7)]


@pytest.mark.parametrize("per_word", [32, 2, 1])
def test_vocab_by_buckets(spark, monkeypatch, per_word):
    """The words of a plain count, also where crowded buckets make a second count necessary; few words are counted singly."""
    monkeypatch.setattr(features, "_BUCKETS", per_word)
    rng, counted, inner = random.Random(per_word), [], features._counted
    monkeypatch.setattr(features, "_counted", lambda *a: counted.append(inner(*a)) or counted[-1])
    rows = [(" ".join(f"w{int(rng.paretovariate(0.6)) % 9000}" for _ in range(60)),) for _ in range(500)] + [(None,), ("",), ("hot " * 20_000,)]
    df = spark.createDataFrame(rows, "text string").repartition(6)
    plain = Counter(w for (text,) in rows for w in (text or "").split())
    for size in (1, 7, 60, 10**5):
        expected = sorted(plain.items(), key=lambda one: (-one[1], one[0]))[:size]
        found = features.build_vocab(df, size).orderBy("id").collect()
        assert [(r.token, r.n) for r in found] == expected and [r.id for r in found] == list(range(4, 4 + len(expected)))
        if per_word == 32 and size <= 60:
            assert sum(c.count() for c in counted) < len(plain) / 4
        counted.clear()
    assert features.build_vocab(df.filter("text = ''"), 5).count() == features.build_vocab(df, 0).count() == 0


@pytest.mark.parametrize("small", [True, False])
def test_encode(spark, texts, small, monkeypatch):
    """Also with a vocabulary that is not broadcast, but for its most frequent word."""
    monkeypatch.setattr(features, "is_small", lambda df: small)
    monkeypatch.setattr(features, "_HOT", 1)
    vocab = features.build_vocab(texts.filter("k < 3"), 3)  # a, b, c
    out = {r.k: r for r in features.encode_fixed(texts, vocab, ["k"], max_len=6, keep=["text"]).collect()}
    assert out[1].input_ids == [0, 5, 4, 2, 1, 1] and out[1].attention_mask == [1, 1, 1, 1, 0, 0]
    assert out[2].input_ids == [0, 4, 3, 6, 6, 2] and out[2].attention_mask == [1] * 6
    assert out[3].input_ids == [0, 2, 1, 1, 1, 1] and out[3].attention_mask == [1, 1, 0, 0, 0, 0]
    assert out[4].input_ids == [0, 3, 3, 3, 3, 2] and out[4].text == "zz " * 9
    ready = tables.to_training_columns(features.encode_fixed(texts.withColumn("class", F.lit(1)), vocab, ["k"], keep=["class"]))
    assert ready.columns == ["input_ids", "attention_mask", "labels"]
    assert all(len(r.input_ids) == len(r.attention_mask) == C.MAX_LEN for r in ready.collect())


def test_metrics(spark):
    rows = [("train", 0, 0), ("train", 1, 1), ("train", 2, 1), ("val", 2, 2), ("test", 0, 2)]
    df = spark.createDataFrame(rows, "split string, prediction int, label int")
    table = {r.dataset: (r.accuracy, r.f1) for r in metrics.metrics_by_split(df).collect()}
    assert table["Train"] == pytest.approx((2 / 3, 2 / 3))
    assert (table["Validation"], table["Test"], table["Baseline"]) == ((1.0, 1.0), (0.0, 0.0), (0.879, 0.879))
    assert metrics.micro_accuracy(df).first()[0] == metrics.micro_f1(df).first()[0] == pytest.approx(0.6)
    empty = df.limit(0)
    assert metrics.micro_accuracy(empty).first()[0] is None
    assert metrics.micro_f1(empty).first()[0] is None


def test_select_best(spark):
    figures = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.9), (3, 0.1)], "candidate int, val_f1 double")
    assert tuple(metrics.select_best(figures).first()) == (1, 0.9)
    assert tuple(metrics.select_best(figures, mode="min").first()) == (3, 0.1)


@pytest.fixture(scope="module")
def labelled(spark):
    """Sentences whose class can be told from one word; texts repeat across splits."""
    words = F.element_at(F.array(F.lit("bad"), F.lit("so so"), F.lit("good")), (F.col("id") % 3 + 1).cast("int"))
    split = F.when(F.col("id") % 10 < 8, "train").when(F.col("id") % 10 < 9, "val").otherwise("test")
    return spark.range(600).select(
        F.concat(F.lit("lesson was "), words, F.lit(" "), (F.col("id") % 5).cast("string")).alias("text"),
        (F.col("id") % 3).cast("int").alias("class"), split.alias("split"),
    )


def test_train_and_answer(spark, labelled):
    weak = {"reg": 1000.0, "passes": 1}
    model, figures = training.train_and_evaluate(labelled, [weak, *classifier.DEFAULT_CANDIDATES], 1 << 10)
    assert {r.dataset: r.accuracy for r in figures.collect()} == {"Train": 1.0, "Validation": 1.0, "Test": 1.0, "Baseline": 0.879}
    requests = spark.createDataFrame([(1, "  lesson  was good 3"), (2, " ")], "k int, text string")
    answers = {r.k: json.loads(r.response) for r in scoring.answer_requests(requests, model).collect()}
    assert answers[1] == {"status": "success", "data": {"classify": "Tích cực"}}
    assert answers[2] == {"status": "error", "message": "Thiếu dữ liệu"}
    scored = classifier.score(labelled.select("text", "class"), model, keep=["class"]).collect()
    for r in scored:
        assert r.sentiment == C.OFFLINE_NAMES[r["class"]]
        assert abs(sum(float(p) for p in r.probabilities.values()) - 1) < 2e-4


def test_fitted_model_on_a_stream(spark, labelled, tmp_path):
    model, _ = classifier.fit_classifier(labelled.withColumn("label", F.col("class").cast("double")), features=1 << 10)
    requests = labelled.select("text", "class").union(spark.createDataFrame([(None, 1)], "text string, class int"))
    requests.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    stream_score(stream, model, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    want = scoring.answer_requests(requests, model)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_fit_without_validation(labelled):
    rows = labelled.withColumn("label", F.col("class").cast("double"))
    model, figures = classifier.fit_classifier(rows, features=1 << 10)
    assert figures is None
    assert classifier.predict(rows, model).filter("prediction <> label").count() == 0
    with pytest.raises(ValueError):
        classifier.fit_classifier(rows, candidates=[*classifier.DEFAULT_CANDIDATES] * 2)


def test_figures_per_candidate(labelled):
    rows = labelled.withColumn("label", F.col("class").cast("double"))
    weak = {"reg": 1000.0, "passes": 1}
    _, figures = classifier.fit_classifier(rows, rows, [weak, *classifier.DEFAULT_CANDIDATES], 1 << 10)
    bad, good = figures.orderBy("candidate").collect()
    assert good.train_accuracy == good.val_accuracy == good.val_f1 == 1 and good.train_loss == pytest.approx(good.val_loss)
    assert bad.val_loss == pytest.approx(1.0986, abs=0.01)


def test_the_course_of_a_fit(labelled):
    model, figures = training.train_by_pass(labelled, {"reg": 0.01, "passes": 6}, 1 << 10)
    rows = figures.orderBy("candidate").collect()
    assert [r.passes for r in rows] == [1, 2, 3, 4, 5, 6]
    assert all(b.objective <= a.objective * (1 + 1e-9) for a, b in zip(rows, rows[1:])) and rows[-1].objective < rows[0].objective
    best = next(r for r in rows if r.val_f1 == max(x.val_f1 for x in rows))
    assert model.stages[-1].getMaxIter() == best.passes
    counted = classifier.count_words(labelled.select("text", F.col("class").cast("double").alias("label"), "split"), 1 << 10)
    whole, _ = classifier.fit_classifier(counted.filter("split = 'train'"), candidates=[{"reg": 0.01, "passes": 6}], features=1 << 10)
    last, _ = classifier.fit_classifier(counted.filter("split = 'train'"), candidates=classifier.each_pass({"reg": 0.01, "passes": 6})[-1:], features=1 << 10)
    assert whole.stages[-1].coefficientMatrix.toArray() == pytest.approx(last.stages[-1].coefficientMatrix.toArray())


def test_combined_splits(spark):
    a = spark.createDataFrame([("train", "x", "2")], "split string, sentence string, sentiment string")
    b = spark.createDataFrame([("y", 0, "val")], "sentence string, sentiment int, split string")
    rows = corpus.combined_splits(a=a, b=b).collect()
    assert sorted((r.source, r.split, r.sentence, r.sentiment) for r in rows) == [("a", "train", "x", 2), ("b", "val", "y", 0)]

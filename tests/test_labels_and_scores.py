"""Label columns, score columns and the tables built from them."""

from __future__ import annotations

import json
import math

from pyspark.sql import functions as F

from labelloom import constants as C
from labelloom.functions import labels as L
from labelloom.functions import scores as S
from labelloom.operators import classifier, tables


def one(spark, value, schema, column):
    return spark.createDataFrame([(value,)], schema).select(column).first()[0]


def many(spark, items, column, kind="string"):
    df = spark.createDataFrame(list(enumerate(items)), f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_label_words(spark):
    assert many(spark, ["negative", "Neutral", "positive", "", None], L.label_from_word("v")) == [0, None, 2, None, None]


def test_label_names(spark):
    assert many(spark, [0, 1, 2, 7, None], L.label_name("v"), "int") == [
        "tiêu cực", "trung lập", "tích cực", "trung lập", "trung lập",
    ]
    assert many(spark, [1, 7], L.label_name("v", C.SERVING_NAMES, None), "int") == ["Trung tính", None]
    assert many(spark, ["Tích cực", "Trung lập", "x"], L.label_from_name("v")) == [2, 1, None]


def test_parse_label(spark):
    texts = [" 2 ", "+2", "-1", "2.0", "", "x", None, "7", "\xa02\t\n", "2\x00", "+", "99999999999"]
    assert many(spark, texts, L.parse_label("v")) == [2, 2, -1, 1, 1, 1, 1, 7, 2, 1, 1, 1]


def test_softmax_and_argmax(spark):
    p = one(spark, [1.0, 2.0, 1000.0], "v array<double>", S.softmax("v"))
    assert p == [0.0, 0.0, 1.0]
    p = one(spark, [0.1, -0.3, 0.2], "v array<double>", S.softmax("v"))
    assert math.isclose(sum(p), 1.0)
    assert math.isclose(p[0] / p[1], math.exp(0.4))
    assert many(spark, [[0.4, 0.4, 0.2], [0.1, 0.2, 0.7]], S.argmax("v"), "array<double>") == [0, 2]


def test_losses(spark):
    row = ([0.1, -0.3, 0.2], 1)
    df = spark.createDataFrame([row], "x array<double>, y int")
    a, b = df.select(S.log_loss_of_logits("x", "y"), S.negative_log_likelihood(S.softmax("x"), "y")).first()
    want = math.log(sum(math.exp(v) for v in row[0])) + 0.3
    assert math.isclose(a, want) and math.isclose(b, want)
    zero = spark.createDataFrame([([0.0, 1.0], 0)], "p array<double>, y int")
    assert zero.select(S.negative_log_likelihood("p", "y")).first()[0] == math.inf


def test_score_record(spark):
    df = spark.createDataFrame([("hay", [0.2, 0.05, 0.75])], "text string, probabilities array<double>")
    r = classifier.score_probabilities(df).first()
    assert (r.text, r.sentiment, r.confidence) == ("hay", "Tích cực", 0.75)
    assert r.probabilities == {"Tiêu cực": "0.2000", "Trung lập": "0.0500", "Tích cực": "0.7500"}


def test_requests_and_responses(spark):
    df = spark.createDataFrame([(1, " hay "), (2, "  "), (3, None)], "i int, text string")
    out = tables.respond(tables.validate_requests(df).withColumn("prediction", F.lit(1))).orderBy("i").collect()
    assert out[0].text == "hay"
    assert json.loads(out[0].response) == {"status": "success", "data": {"classify": "Trung tính"}}
    for bad in out[1:]:
        assert bad.response == '{"status":"error","message":"Thiếu dữ liệu"}'


def test_column_repairs(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, text int")
    assert [r["class"] for r in tables.ensure_column(df).collect()] == [1, 1]
    assert tables.ensure_column(df, "text").columns == ["id", "text"]
    assert [r.text for r in tables.cast_text(df).orderBy("id").collect()] == [None, "5"]
    assert [r.text for r in tables.cast_text(df, null_text="nan").orderBy("id").collect()] == ["nan", "5"]
    blank = spark.createDataFrame([(" a ",), (" ",), ("",)], "t string")
    assert [r.t for r in tables.drop_blank(blank, "t").collect()] == ["a"]


def test_combine_sources(spark):
    a = spark.createDataFrame([("x", 1)], "t string, n int")
    b = spark.createDataFrame([(2, "y")], "n int, t string")
    assert sorted(map(tuple, tables.combine_sources(a=a, b=b).collect())) == [("x", 1, "a"), ("y", 2, "b")]

"""From three kinds of source files to the final corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import text as T
from labelloom.operators import quota, splits
from labelloom.plans import corpus
from labelloom.sources import csv, lines, sinks

SENTENCE = "câu phản hồi thứ %02d, đủ dài để được giữ lại trong tập dữ liệu"


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content)


def test_three_sources_to_final_corpus(spark, tmp_path):
    for split, n in (("train", 8), ("val", 1), ("test", 2)):
        put(tmp_path / f"aligned/{split}/sents.txt", "".join(f'{split} "{i}"\n' for i in range(n)))
        put(tmp_path / f"aligned/{split}/sentiments.txt", "".join(f"{i % 3}\n" for i in range(n)))
    aligned, _ = lines.read_aligned_lines(
        spark, str(tmp_path / "aligned"), {"sentence": "sents.txt", "sentiment": "sentiments.txt"}
    )
    aligned = corpus.clean_sentences(aligned)

    words = ["negative", "neutral", "positive", "unsure"]
    put(tmp_path / "words/train.csv", "text,label\n" + "".join(f'"w, {i}",{words[i % 4]}\n' for i in range(20)))
    worded = corpus.clean_sentences(csv.read_csv_dir(spark, str(tmp_path / "words")), label_words=True)
    worded = worded.withColumn("no", F.regexp_extract("sentence", r"\d+", 0).cast("int"))
    worded = splits.tail_holdout(worded, ["no"], exclude_from_train=True)

    response = "\n".join(SENTENCE % i + ",2" for i in range(30))
    asked = spark.createDataFrame([("vui", 2, 0, response)], "category string, label int, no int, response string")
    categories = quota.category_table(spark, {"vui": 2, "buồn": 0})
    sink = str(tmp_path / "sink")
    sinks.append_with_header(corpus.fill_categories(asked, categories, None, ["no"], 20), sink)
    stored = spark.read.parquet(sink)
    assert {tuple(r) for r in quota.remaining_quota(categories, quota.progress(stored), 20).collect()} == {("buồn", 0, 20)}
    filled = splits.split_ordered(stored, ["no", "line_no"])

    combined = corpus.combined_splits(aligned=aligned, worded=worded, filled=filled)
    counts = {(r.source, r.split): r["count"] for r in combined.groupBy("source", "split").count().collect()}
    assert counts == {
        ("aligned", "train"): 8, ("aligned", "val"): 1, ("aligned", "test"): 2,
        ("worded", "train"): 18, ("worded", "test"): 2,
        ("filled", "train"): 16, ("filled", "val"): 2, ("filled", "test"): 2,
    }
    assert combined.filter(F.contains("sentence", F.lit('"'))).count() == 0

    folder = str(tmp_path / "final")
    for split in ("train", "val", "test"):
        part = combined.filter(F.col("split") == split).select(F.col("sentence").alias("text"), "sentiment")
        sinks.write_csv(part, f"{tmp_path}/combined/{split}.csv")
        raw = csv.read_raw_rows(spark, f"{tmp_path}/combined/{split}.csv").withColumn("split", F.lit(split))
        sinks.write_final_csv(corpus.final_corpus(raw), f"{folder}/{split}.csv")
    final = csv.read_splits(spark, folder)
    assert final.count() == combined.count() == final.select("split", "id").distinct().count()
    defaulted = final.filter(F.col("text").startswith("w, ")).join(worded.select(F.col("sentence").alias("text"), "sentiment"), "text")
    assert defaulted.filter(F.coalesce("sentiment", F.lit(1)) != F.col("class")).count() == 0
    assert final.filter(T.strip_text("text") == "").count() == 0

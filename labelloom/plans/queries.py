"""One query per operator on the provided tables, for the SQL check and for timing.

``feedback`` stands for a labelled corpus: the lines of all labelled documents, with the document's
source as category and a class from its two flags.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom import constants as C
from labelloom.functions import labels as L
from labelloom.functions import scores as S
from labelloom.functions import text as T
from labelloom.operators import classifier, features, generated, metrics, paraphrase, positions, quota, splits, tables
from labelloom.plans import corpus, scoring, training
from labelloom.sources import csv, lines, sinks
from labelloom.staging import hadoop_path, new_path, stage
from labelloom.streaming.quota import stream_accept_rows, stream_accept_to_quota
from labelloom.streaming.scoring import stream_score

TARGET = 1500
VOCAB_SIZE = 1000
EVENT_LABELS = {"error": 0, "view": 1, "click": 2, "purchase": 2, "signup": 2}
WORDS = {0: "negative", 1: "Neutral", 2: "positive"}
# Texts made awkward, for queries whose rules plain prose does not reach; both engines read this expression. White space
# of many kinds at the ends, quotes and tabs, backslashes before commas and alone, NULL.
AWKWARD = """CASE doc_id % 7
  WHEN 0 THEN chr(160) || chr(28) || text || chr(9) || ' '
  WHEN 1 THEN replace(text, ' ', chr(34) || chr(9) || '  ')
  WHEN 2 THEN replace(text, '. ', chr(92) || ', ')
  WHEN 3 THEN replace(text, 'e', chr(92))
  WHEN 4 THEN NULL
  WHEN 5 THEN replace(text, 'n', chr(13))
  ELSE text END"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def document_class() -> Column:
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "text", "lang", F.col("source").alias("category"))
    flags = table(spark, sf, "labels").select("doc_id", "quality", document_class().alias("class"))
    return documents.join(flags, "doc_id")


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    return labelled_documents(spark, sf).select(
        "doc_id", "lang", "category", "class", F.posexplode(F.split("text", "\n")).alias("line_no", "sentence")
    )


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Per labelled document a response of ``<line>,<class>`` lines; no neutral class is ever asked for."""
    answer = F.transform(F.split("text", "\n"), lambda line: F.concat(line, F.lit(","), F.col("class").cast("string")))
    return labelled_documents(spark, sf).select(
        "doc_id",
        "category",
        F.when(F.col("quality") == 1, 2).otherwise(0).alias("label"),
        F.array_join(answer, "\n").alias("response"),
    )


def event_rows(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "ts", F.col("event_type").alias("category"), L.lookup("event_type", EVENT_LABELS).alias("label")
    )


def event_categories(spark: SparkSession) -> DataFrame:
    return quota.category_table(spark, EVENT_LABELS)


def stored_events(events: DataFrame) -> DataFrame:
    """What an earlier run is taken to have stored: all errors, and everything of the first twelve hours."""
    return event_rows(events).filter((F.col("category") == "error") | _first_hours())


def arriving_events(events: DataFrame) -> DataFrame:
    return event_rows(events).filter((F.col("category") == "error") | ~_first_hours())


def _first_hours() -> Column:
    return F.col("ts") < F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")


# --- text and labels -------------------------------------------------------------------------


def awkward_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumn("text", F.expr(AWKWARD))


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return awkward_documents(spark, sf).select(
        "doc_id",
        T.strip_text("text").alias("stripped"),
        T.collapse_whitespace("text").alias("collapsed"),
        T.remove_quotes("text").alias("unquoted"),
    )


def nonblank_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = feedback(spark, sf).withColumn("text", F.col("sentence")).withColumn("sentence", F.expr(AWKWARD))
    return tables.drop_blank(rows.select("doc_id", "line_no", "sentence"), "sentence")


def label_map(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "labels").withColumn("word", L.lookup(document_class(), WORDS))
    coded = tables.map_label_words(words.withColumn("code", F.col("word")), "code")
    named = coded.withColumn("name", L.label_name("code"))
    code_of_name = L.label_from_name("name", C.PROMPT_NAMES).alias("code_of_name")
    return named.select("doc_id", "word", F.col("code").cast("string").alias("code"), "name", code_of_name)


def parse_label(spark: SparkSession, sf: str) -> DataFrame:
    number = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select(
        "event_id", L.parse_label(number).alias("parsed"), L.parse_label("props").alias("failed")
    )


def generated_lines(spark: SparkSession, sf: str) -> DataFrame:
    return generated.parse_generated_lines(responses(spark, sf), keep=["doc_id"])


# --- paraphrases -----------------------------------------------------------------------------


def split_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Staged first: a split reads the keys twice before it reads the rows."""
    return splits.split_stratified(stage(feedback(spark, sf), "feedback"), ["doc_id", "line_no"], ["class"], method="md5")


def paraphrase_requests(spark: SparkSession, sf: str) -> DataFrame:
    return paraphrase.render_paraphrase_requests(split_feedback(spark, sf), ["doc_id", "line_no"], label="class")


def paraphrase_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = feedback(spark, sf).select("doc_id", "line_no", "lang", "class", "sentence")
    answer = F.concat(F.lit(' "Again: '), F.col("sentence"), F.lit('" '))
    answers = rows.filter("lang = 'en'").select("doc_id", "line_no", answer.alias("answer"))
    return paraphrase.apply_paraphrases(rows, answers, ["doc_id", "line_no"])


def paraphrase_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Answers for all English rows, taken over in val and test only."""
    rows = split_feedback(spark, sf).select("doc_id", "line_no", "lang", "class", "split", "sentence")
    answers = rows.filter("lang = 'en'").select("doc_id", "line_no", F.concat(F.lit("Again: "), "sentence").alias("answer"))
    return paraphrase.apply_paraphrases(rows, answers, ["doc_id", "line_no"], splits=["val", "test"])


# --- quotas ----------------------------------------------------------------------------------


def quota_progress(spark: SparkSession, sf: str) -> DataFrame:
    return quota.progress(stored_events(table(spark, sf, "events")))


def quota_remaining(spark: SparkSession, sf: str) -> DataFrame:
    remaining = quota.remaining_quota(event_categories(spark), quota_progress(spark, sf), TARGET)
    return quota.with_category_key(remaining)


def quota_total(spark: SparkSession, sf: str) -> DataFrame:
    return quota.total_generated(event_categories(spark), quota_progress(spark, sf))


def quota_accept(spark: SparkSession, sf: str) -> DataFrame:
    remaining = quota.remaining_quota(event_categories(spark), quota_progress(spark, sf), TARGET)
    batch = arriving_events(table(spark, sf, "events")).select("event_id", "ts", "category", "label")
    return quota.accept_to_quota(batch, remaining, ["ts", "event_id"]).drop("ts")


def quota_accept_large(spark: SparkSession, sf: str) -> DataFrame:
    """A quota too large to be ranked in one task; some categories stay open."""
    target = 20_050
    remaining = quota.remaining_quota(event_categories(spark), quota_progress(spark, sf), target)
    batch = arriving_events(table(spark, sf, "events")).select("event_id", "ts", "category", "label")
    return quota.accept_to_quota(batch, remaining, ["ts", "event_id"]).drop("ts")


def filled_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Lines accepted from responses, 20 per category and label."""
    asked = responses(spark, sf)
    categories = asked.select("category", "label").distinct()
    return corpus.fill_categories(asked, categories, None, ["doc_id"], 20)


# --- order and splits ------------------------------------------------------------------------


def split_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_ordered(table(spark, sf, "documents").select("doc_id"), ["doc_id"])


def tail_holdout(spark: SparkSession, sf: str) -> DataFrame:
    return splits.tail_holdout(table(spark, sf, "documents").select("doc_id"), ["doc_id"])


def tail_holdout_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id")
    return splits.tail_holdout(documents, ["doc_id"], exclude_from_train=True)


def split_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return split_feedback(spark, sf).select("doc_id", "line_no", "class", "split")


def split_profile(spark: SparkSession, sf: str) -> DataFrame:
    return splits.profile_splits(splits.split_ordered(table(spark, sf, "documents"), ["doc_id"]))


def preview(spark: SparkSession, sf: str) -> DataFrame:
    return splits.preview(table(spark, sf, "documents"), ["doc_id"], 5)


def batches(spark: SparkSession, sf: str) -> DataFrame:
    return splits.shuffle_into_batches(table(spark, sf, "documents").select("doc_id"), ["doc_id"], method="md5")


def ordered_batches(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id")
    return splits.in_batches(positions.with_positions(documents, ["doc_id"]))


def epoch_order(spark: SparkSession, sf: str) -> DataFrame:
    """The third epoch's order of the documents, by arithmetic on their positions."""
    placed = stage(positions.with_positions(table(spark, sf, "documents").select("doc_id"), ["doc_id"]), "positions")
    return splits.epoch_batches(placed, epoch=2, method="md5")


def final_ids(spark: SparkSession, sf: str) -> DataFrame:
    numbered = positions.with_positions(table(spark, sf, "documents").select("doc_id"), ["doc_id"], total="n")
    return splits.assign_ids(splits.split_positions(numbered, total="n")).select("doc_id", "split", "id")


# --- tables ----------------------------------------------------------------------------------


def ensure_columns(spark: SparkSession, sf: str) -> DataFrame:
    flags = table(spark, sf, "labels").withColumn("text", F.nullif(F.col("quality"), F.lit(0)))
    repaired = tables.ensure_column(tables.ensure_column(flags), "toxic", 9)
    return tables.cast_text(repaired, null_text="nan").select("doc_id", "text", "toxic", "class")


def combine_sources(spark: SparkSession, sf: str) -> DataFrame:
    def rows(name: str, key: str) -> DataFrame:
        return table(spark, sf, name).select(F.col(key).alias("key"), "text")

    return tables.combine_sources(
        documents=rows("documents", "doc_id"),
        conversations=rows("conversations", "conv_id"),
        benchmark=rows("benchmark", "item_id"),
    )


# --- encoding --------------------------------------------------------------------------------


def _as_text(*arrays: str) -> list[Column]:
    return [F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in arrays]


def vocab(spark: SparkSession, sf: str) -> DataFrame:
    return features.build_vocab(table(spark, sf, "documents"), VOCAB_SIZE)


def encode_fixed(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "text")
    encoded = features.encode_fixed(documents, vocab(spark, sf), ["doc_id"])
    return encoded.select("doc_id", *_as_text("input_ids", "attention_mask"))


def training_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = labelled_documents(spark, sf).select("doc_id", "text", "class")
    encoded = features.encode_fixed(rows, vocab(spark, sf), ["doc_id"], C.SERVING_MAX_LEN, keep=["class"])
    ready = tables.to_training_columns(encoded)
    return ready.select(*_as_text("input_ids", "attention_mask"), "labels")


# --- scores and metrics ----------------------------------------------------------------------


# First dimension, from 1, and number of dimensions of each logit.
LOGIT_PARTS = ((1, 21), (22, 21), (43, 22))


def logit_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Logits from all dimensions: sums over three neighbouring parts of the vector."""
    whole = F.col("embedding").cast("array<double>")
    parts = [F.slice(whole, start, n) for start, n in LOGIT_PARTS]
    logits = F.array(*[F.aggregate(part, F.lit(0.0), lambda a, x: a + x) for part in parts])
    return table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 3).alias("label"), logits.alias("logits"))


def predicted_rows(spark: SparkSession, sf: str) -> DataFrame:
    probable = logit_rows(spark, sf).withColumn("probabilities", S.softmax("logits"))
    return probable.withColumn("prediction", S.argmax("probabilities"))


def softmax_argmax(spark: SparkSession, sf: str) -> DataFrame:
    p = [F.round(F.get("probabilities", F.lit(i)), 9).alias(f"p{i}") for i in range(C.NUM_CLASSES)]
    return predicted_rows(spark, sf).select("vec_id", *p, "prediction")


def score_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = predicted_rows(spark, sf).withColumn("text", F.col("vec_id").cast("string"))
    scored = classifier.score_probabilities(rows)
    shown = [F.element_at("probabilities", name).alias(f"p{code}") for code, name in C.OFFLINE_NAMES.items()]
    return scored.select("text", "sentiment", F.round("confidence", 9).alias("confidence"), *shown)


def accuracy_f1_loss(spark: SparkSession, sf: str) -> DataFrame:
    figures = {
        "accuracy": metrics.accuracy(),
        "f1": metrics.f1(),
        "loss": F.avg(S.negative_log_likelihood("probabilities", "label")),
        "logit_loss": F.avg(S.log_loss_of_logits("logits", "label")),
    }
    return predicted_rows(spark, sf).groupBy("label").agg(*[F.round(c, 6).alias(name) for name, c in figures.items()])


def pooled_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = predicted_rows(spark, sf)
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.round(metrics.accuracy(), 6).alias("accuracy"),
        F.round(metrics.f1(), 6).alias("f1"),
        F.round(F.avg(S.negative_log_likelihood("probabilities", "label")), 6).alias("loss"),
    )


def metrics_by_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.split_ordered(predicted_rows(spark, sf), ["vec_id"])
    return metrics.metrics_by_split(rows).select("dataset", F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


def select_best(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates are groups of four neighbouring dimensions: two logits, and the sum of two as the third."""
    rows = table(spark, sf, "embeddings").select(
        (F.col("label") % 3).alias("label"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("candidate")
    )
    four = F.slice(F.col("embedding").cast("array<double>"), F.col("candidate") * 4 + 1, 4)
    logits = F.array(four[0], four[1], four[2] + four[3])
    figures = metrics.micro_f1(rows.withColumn("prediction", S.argmax(S.softmax(logits))), ["candidate"])
    best = metrics.select_best(figures.withColumnRenamed("f1", "val_f1"))
    return best.withColumn("val_f1", F.round("val_f1", 6))


def respond_json(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("role") == "system", F.lit(" \t\n")).otherwise(F.col("text")).alias("text")
    checked = tables.validate_requests(table(spark, sf, "conversations").select("conv_id", "turn", text))
    answered = tables.respond(checked.withColumn("prediction", F.length("text") % 3))
    return answered.select("conv_id", "turn", "response")


def fit_and_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = split_feedback(spark, sf).withColumnRenamed("sentence", "text")
    model, _ = training.train_and_evaluate(rows)
    return classifier.score(rows, model, keep=["doc_id", "line_no", "split"])


def fit_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Measured figures beside the share of the most frequent class."""
    rows = split_feedback(spark, sf).withColumnRenamed("sentence", "text")
    candidates = [{"reg": reg, "passes": C.MAX_PASSES} for reg in (C.WEIGHT_DECAY, 0.1)]
    _, measured = training.train_and_evaluate(rows, candidates)
    counts = rows.groupBy("class").count()
    majority = counts.agg((F.max("count") / F.sum("count")).alias("accuracy"))
    return measured.unionByName(majority.select(F.lit("Majority").alias("dataset"), "accuracy", F.col("accuracy").alias("f1")))


def fit_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of a fitted model, per split: all rows are scored, with classes and probabilities in range, and on
    train no worse than always saying the most frequent class."""
    rows = stage(split_feedback(spark, sf).withColumnRenamed("sentence", "text"), "rows")
    model, _ = training.train_and_evaluate(rows)
    scored = classifier.predict(rows.select("split", "text", "class"), model)
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
    fine = F.every(F.col("prediction").between(0, C.NUM_CLASSES - 1)), F.every(F.abs(total - 1) < 1e-6)
    right = F.count_if(F.col("prediction") == F.col("class"))
    most = F.greatest(*[F.count_if(F.col("class") == c) for c in range(C.NUM_CLASSES)])
    return scored.groupBy("split").agg(
        F.count("*").alias("n_rows"), fine[0].alias("in_range"), fine[1].alias("sums_to_one"),
        ((F.col("split") != "train") | (right >= most)).alias("beats_majority"),
    )


def pass_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the course of a fit, per pass: the objective never rises, figures are in range, and the model that
    is given back is the one of the pass with the best F1 on val."""
    rows = stage(split_feedback(spark, sf).withColumnRenamed("sentence", "text"), "rows")
    model, figures = training.train_by_pass(rows)
    held_out = classifier.predict(rows.filter("split = 'val'").select("text", F.col("class").alias("label")), model)
    reached = held_out.agg(metrics.f1().alias("reached"))
    before = F.lag("objective").over(Window.orderBy("passes"))  # a row per pass
    shares = [F.col(c).between(0, 1) for c in ("train_accuracy", "val_accuracy", "val_f1")]
    fine = shares[0] & shares[1] & shares[2] & (F.col("train_loss") > 0) & (F.col("val_loss") > 0)
    best = figures.agg(F.max("val_f1").alias("best")).join(reached).select((F.abs(F.col("best") - F.col("reached")) < 1e-9).alias("best_kept"))
    fell = (before.isNull() | (F.col("objective") <= before * (1 + 1e-9))).alias("objective_fell")
    return figures.select("passes", fell, fine.alias("in_range")).join(F.broadcast(best))


# --- sources and sinks -----------------------------------------------------------------------


def _in_order(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def zip_by_position(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences and codes written as two aligned files, blank lines included, and read back."""
    folder = new_path(spark, "aligned")
    rows = feedback(spark, sf).select("doc_id", "line_no", "sentence", "class")
    code = F.when(T.strip_text("sentence") == "", "").otherwise(F.col("class").cast("string"))
    for name, value in (("sents", F.col("sentence")), ("sentiments", code)):
        _in_order(rows, "doc_id", "line_no").select(value.alias("value")).write.text(f"{folder}/train/{name}")
    zipped, _ = lines.read_aligned_lines(spark, folder, {"sentence": "sents", "sentiment": "sentiments"})
    return zipped


def zip_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in order of their number beside documents in order of their length."""
    left = table(spark, sf, "documents").select("doc_id")
    right = table(spark, sf, "documents").select("n_chars", F.col("doc_id").alias("by_length"))
    return lines.zip_tables(left, right, ["doc_id"], ["n_chars", "by_length"])


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.split_ordered(awkward_documents(spark, sf), ["doc_id"])
    path = new_path(spark, "csv")
    sinks.write_corpus(rows.select("split", F.col("text").alias("sentence"), F.col("lang").alias("sentiment")), path, "csv")
    return csv.read_csv_dir(spark, f"{path}/split=*").select("sentence", "sentiment")


def parquet_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.split_ordered(table(spark, sf, "documents"), ["doc_id"])
    path = new_path(spark, "corpus")
    sinks.write_corpus(rows.select("split", F.col("text").alias("sentence"), F.col("lang").alias("sentiment")), path)
    return spark.read.parquet(path).select("split", "sentence", "sentiment")


def final_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    rows = positions.with_positions(labelled_documents(spark, sf).select("doc_id", "text", "class"), ["doc_id"], total="n")
    final = splits.assign_ids(splits.split_positions(rows, total="n"))
    folder = new_path(spark, "final")
    for split in ("train", "val", "test"):
        sinks.write_final_csv(final.filter(F.col("split") == split), f"{folder}/{split}.csv")
    return csv.read_splits(spark, folder)


def raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with labels, some of which are no numbers, written as CSV and read by position."""
    label = F.when(F.col("class") == 0, "bad").otherwise(F.col("class").cast("string"))
    rows = labelled_documents(spark, sf).select("doc_id", F.expr(AWKWARD).alias("text"), label.alias("label"))
    path = new_path(spark, "raw")
    sinks.write_csv(_in_order(rows, "doc_id").select("text", "label"), path)
    return csv.with_parsed_label(csv.read_raw_rows(spark, path))


def lenient_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the documents taken as CSV lines: whatever has more than two fields is dropped."""
    line = T.remove_quotes("sentence").alias("sentence,sentiment")
    path = new_path(spark, "lenient")
    sinks.write_plain(feedback(spark, sf).select(line), path)
    return csv.read_csv_lenient(spark, path)


def lenient_split(spark: SparkSession, sf: str) -> DataFrame:
    """Whole awkward texts, line breaks and quotes included, written as CSV and split in file order after a lenient read."""
    path = new_path(spark, "lenient")
    rows = _in_order(awkward_documents(spark, sf).select("doc_id", "text", "lang"), "doc_id")
    sinks.write_csv(rows.select(F.col("text").alias("sentence"), F.col("lang").alias("sentiment")), path)
    read = csv.read_csv_lenient(spark, path, "quoted", positions=True)
    return splits.split_ordered(read, ["pos"]).select("sentence", "sentiment", "split")


def lenient_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """Lines taken as CSV lines, some with too many fields, and the last tenth of the others in file order."""
    path = new_path(spark, "lenient")
    line = T.remove_quotes("sentence").alias("sentence,sentiment")
    sinks.write_plain(_in_order(feedback(spark, sf).select("doc_id", "line_no", "sentence"), "doc_id", "line_no").select(line), path)
    read = csv.read_csv_lenient(spark, path, positions=True)
    return splits.tail_holdout(read, ["pos"]).select("sentence", "sentiment", "split")


def final_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job: aligned files, CSV files with label words and generated responses, each cleaned and split, combined
    and given ids."""
    folder = new_path(spark, "aligned")
    rows = _in_order(feedback(spark, sf).select("doc_id", "line_no", "sentence", "class"), "doc_id", "line_no")
    rows = stage(rows.filter(T.strip_text("sentence") != ""), "aligned-rows")
    for name, value in (("sents", F.col("sentence")), ("sentiments", F.col("class").cast("string"))):
        _in_order(rows, "doc_id", "line_no").select(value.alias("value")).write.text(f"{folder}/train/{name}")
    aligned, _ = lines.read_aligned_lines(spark, folder, {"sentence": "sents", "sentiment": "sentiments"}, ["train"])
    aligned = corpus.clean_sentences(splits.split_ordered(aligned.drop("split"), ["pos"]))

    path = new_path(spark, "words")
    worded = labelled_documents(spark, sf).withColumn("word", L.lookup(F.col("class"), WORDS))
    worded = _in_order(worded, "doc_id").select(F.col("text").alias("sentence"), F.col("word").alias("sentiment"))
    sinks.write_csv(worded, f"{path}/words.csv")
    worded = corpus.clean_sentences(csv.read_csv_dir(spark, f"{path}/*.csv", positions=True), label_words=True)
    worded = splits.tail_holdout(worded, ["pos"], exclude_from_train=True)

    asked = responses(spark, sf)
    filled = stage(corpus.fill_categories(asked, asked.select("category", "label").distinct(), None, ["doc_id"], 20), "filled")
    filled = splits.split_ordered(filled, ["category", "label", "doc_id", "line_no"])

    combined = stage(corpus.combined_splits(aligned=aligned, worded=worded, filled=filled), "combined")
    # rows that are equal in all of these are interchangeable
    raw = positions.with_positions(combined, ["source", "sentence", "sentiment"], ["split"])
    label = F.col("sentiment").cast("string").alias("label")
    return corpus.final_corpus(raw.select("split", "pos", F.col("sentence").alias("text"), label))


def answered_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form of ``stream_scores``."""
    requests = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return scoring.answer_requests(requests, letter_model()).select("conv_id", "turn", "response")


def unquoted_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "unquoted")
    sinks.write_unquoted(table(spark, sf, "documents"), path, "text", "lang")
    return lines.read_unquoted(spark, path, ("sentence", "sentiment"))


def escaped_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Awkward texts as unquoted lines below a header, read by the lenient reader."""
    path = new_path(spark, "escaped")
    rows = awkward_documents(spark, sf).select(F.col("text").alias("sentence"), F.col("lang").alias("sentiment"))
    sinks.write_unquoted(rows, path, "sentence", "sentiment", header=True)
    return csv.read_csv_lenient(spark, path, "unquoted")


def append_and_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """Two appended batches, kept as version 1 and rewritten with category keys as version 2."""
    rows = event_rows(table(spark, sf, "events")).select("event_id", "category", "label")
    appended, versions = new_path(spark, "appended"), new_path(spark, "versions")
    sinks.append_with_header(rows.filter("category = 'error'"), appended)
    sinks.append_with_header(rows.filter("category <> 'error'"), appended)
    sinks.rewrite_safely(spark.read.parquet(appended), versions, 1)
    sinks.rewrite_safely(quota.with_category_key(sinks.read_latest(spark, versions)), versions, 2)
    return sinks.read_latest(spark, versions)


# --- streams ---------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream. A folder of files is its own path; a single file can only be named within the folder it is in."""
    source = spark.readStream.schema(table(spark, sf, name).schema)
    path, files = hadoop_path(spark, f"{sf}/{name}.parquet")
    if files.getFileStatus(path).isDirectory():
        return source.parquet(f"{sf}/{name}.parquet")
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def stream_quota(spark: SparkSession, sf: str) -> DataFrame:
    sink, checkpoint = new_path(spark, "stream"), new_path(spark, "checkpoint")
    rows = event_rows(_stream(spark, sf, "events"))
    stream_accept_rows(rows, event_categories(spark), sink, checkpoint, ["ts", "event_id"], TARGET).awaitTermination()
    return spark.read.parquet(sink).select("event_id", "category", "label")


def stream_generated(spark: SparkSession, sf: str) -> DataFrame:
    """Responses arriving in three parts, each taken by a restart of the stream, parsed and accepted up to 20 lines per
    category."""
    arriving, sink, checkpoint = (new_path(spark, name) for name in ("arriving", "stream", "checkpoint"))
    rows = responses(spark, sf)
    bounds = rows.agg(F.percentile_approx("doc_id", [0.3, 0.6]).alias("b")).first().b
    categories = stage(rows.select("category", "label").distinct(), "categories")
    low = [float("-inf"), *bounds]
    for start, end in zip(low, [*low[1:], float("inf")]):  # in order of arrival
        rows.filter((F.col("doc_id") >= start) & (F.col("doc_id") < end)).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(rows.schema).parquet(arriving)
        stream_accept_to_quota(stream, categories, sink, checkpoint, ["doc_id"], 20).awaitTermination()
    return spark.read.parquet(sink).select("category", "label", "doc_id", "line_no", "sentence", "sentiment")


def letter_model() -> SQLTransformer:
    """A fixed rule in place of a fitted model, so that SQL can repeat it: letters counted as scores."""
    counts = ", ".join(f"double(length(text) - length(replace(text, '{c}', '')))" for c in "aei")
    return SQLTransformer(statement=f"SELECT *, array({counts}) AS probability FROM __THIS__")


def stream_scores(spark: SparkSession, sf: str) -> DataFrame:
    sink, checkpoint = new_path(spark, "stream"), new_path(spark, "checkpoint")
    requests = _stream(spark, sf, "conversations").select("conv_id", "turn", "text")
    stream_score(requests, letter_model(), sink, checkpoint).awaitTermination()
    return spark.read.parquet(sink).select("conv_id", "turn", "response")


# --- the flagship ----------------------------------------------------------------------------


def corpus_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled lines, cleaned, gated by length, capped per category, split by class, counted."""
    lines_ = feedback(spark, sf).withColumn("sentence", T.remove_quotes("sentence"))
    gated = lines_.filter(T.has_sentence_length("sentence")).withColumn("label", F.col("class"))
    gated = stage(gated.select("category", "label", "class", "doc_id", "line_no"), "gated")
    categories = gated.select("category", "label").distinct()
    remaining = quota.remaining_quota(categories, quota.progress(gated.limit(0)), 50)
    accepted = quota.accept_to_quota(gated, remaining, ["doc_id", "line_no"])
    split = splits.split_stratified(stage(accepted, "accepted"), ["doc_id", "line_no"], ["class"], method="md5")
    return split.groupBy("split", "class").agg(F.count("*").alias("n_rows"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        clean_text, nonblank_lines, label_map, parse_label, generated_lines,
        paraphrase_requests, paraphrase_merge, paraphrase_splits,
        quota_progress, quota_remaining, quota_total, quota_accept, quota_accept_large, filled_categories,
        split_ordered, tail_holdout, tail_holdout_disjoint, split_stratified, split_profile, preview,
        batches, ordered_batches, epoch_order, final_ids, ensure_columns, combine_sources,
        vocab, encode_fixed, training_columns,
        softmax_argmax, score_records, accuracy_f1_loss, pooled_metrics, metrics_by_split, select_best,
        respond_json, fit_and_score, fit_metrics, fit_checks, pass_checks,
        zip_by_position, zip_tables, csv_round_trip, parquet_round_trip, final_csv_round_trip, raw_rows,
        lenient_rows, lenient_split, lenient_holdout, final_corpus, answered_requests, unquoted_round_trip, escaped_rows, append_and_rewrite,
        stream_quota, stream_generated, stream_scores, corpus_slice,
    )
}

"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import alignment, bpe, fingerprints, licenses, neardup, ngrams, packing, quality, runs, secret_scans, token_counts, toxicity, warc
from labelloom.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pieces(table(spark, sf_dir, "documents"), bpe.vocabulary_path())
    return packing.pack(found, ["doc_id", "piece", "ids_crc32"])


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), None, bpe.vocabulary_path())


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    names = [*[f"p_{c}" for c in toxicity.CATEGORIES], "toxic"]
    return found.select("doc_id", *[f"_toxicity.{n}" for n in names], (~F.col("_toxicity.toxic")).alias("kept"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.digest(secret_scans.scanned(table(spark, sf_dir, "documents")))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("original").alias("refers_to"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bpe.vocabulary_path()
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id",
        F.shiftright(F.octet_length("ids"), 2).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select("doc_id", *[f"_quality.{n}" for n in names])


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [bpe.vocabulary_path(name) for name in (alignment.BYTE_VOCABULARY, alignment.PIECE_VOCABULARY)]
    return alignment.linked(table(spark, sf_dir, "documents"), *paths)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.scanned(runs.planted(table(spark, sf_dir, "documents"))))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ngrams.scored(docs, ngrams.Model(docs.filter(~ngrams.held_out(docs["doc_id"]))))


QUERIES = {q.__name__: q for q in (op1_best_fit_packing, op2_token_counts, op3_document_fingerprints, op4_toxicity_chain, op5_secret_scans, op6_warc_revisits, op7_bpe_round_trip, op8_license_scans, op9_minhash_near_dedup, op10_quality_rules, op11_tokenizer_alignment, op12_periodic_runs, op13_lm_scores)}
ORACLES: dict[str, str] = {"op10_quality_rules": quality.oracle_sql(), "op5_secret_scans": secret_scans.oracle_sql(), "op6_warc_revisits": warc.oracle_sql()}

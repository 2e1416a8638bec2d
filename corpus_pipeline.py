"""The corpus pipeline: quality rules, toxicity, near-duplicates, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept. All but the
last return the columns of ``documents``; ``run`` writes what each returns to the shared folder and
hands the next one a reader of it. Null texts count as empty, so the quality rules drop them; repeated
rows are copies, of which near-duplicate removal keeps one; other columns than those of ``documents``
are not carried on. A stage that gets no rows returns none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import bpe, neardup, packing, quality, secret_scans, toxicity
from labelloom.llm.common import table
from labelloom.staging import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the thresholds of their language and source."""
    return quality.judged(docs.select(*COLUMNS)).filter("_quality.kept").select(*COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic. It learns from the labels of documents still there."""
    found = toxicity.scored(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return found.filter(~F.col("_toxicity.toxic")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id: five-word shingles, similarity 0.8."""
    return neardup.representatives(docs.select(*COLUMNS))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and the number of characters brought up to date."""
    return secret_scans.masked(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most 2048 tokens."""
    return packing.pack(packing.pieces(docs, bpe.vocabulary_path()), ["doc_id", "piece", "ids_crc32"])


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near-duplicates", near_dedup),
    ("secret scans", secret_masking),
    ("best-fit packing", best_fit_packing),
]

#: Fitted models and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: quality classifier, near-duplicates, personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it left; all but the last return the
columns of `documents`, and further columns of the input, whatever their names. Empty input passes through every stage; what null
and odd rows become is stated by the operators. Rows that repeat an id with other texts are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.mixing import resample
from tidemark.llm.near_dups import drop_near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.pii import redact
from tidemark.llm.quality_fm import fit, with_score
from tidemark.llm.text_sql import fresh
from tidemark.plans.staging import stage
from tidemark.sources.tables import table

THRESHOLD = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives label 1 at least THRESHOLD; it is fitted on the labelled ones among `docs`."""
    score = fresh(docs, "quality_score")
    scored = with_score(docs, fit(docs, table(spark, sf_dir, "labels")), score)
    return scored.filter(F.col(score) >= THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 of their five-word shingles."""
    return drop_near_duplicates(docs, 5, 0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kind; n_chars follows the text where that changed."""
    before = fresh(docs, "text_before")
    cleaned = redact(docs.withColumn(before, F.col("text")))
    same = F.col("text").eqNullSafe(F.col(before))
    return cleaned.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, none more than three times."""
    return resample(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in windows of 2048."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: Training a classifier is not expressible in SQL; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

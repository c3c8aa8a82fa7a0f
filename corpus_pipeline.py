"""The corpus pipeline: each stage works on all rows that the one before has kept.

Every stage but the last returns the columns of documents; a stage's result is
written as a table and read again, so a lost executor costs one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchtide.llm import bytebpe, decontaminate, neardup, pii, quality
from batchtide.llm.shared import written


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars again says how long the text is, where it did before; a null text keeps what it had."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (five-word shingles, similarity of 0.8 or more)."""
    return neardup.one_of_each(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of test items' windows are cut out."""
    return _recounted(decontaminate.without_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed spans are replaced by their kind."""
    return _recounted(docs.withColumn("text", pii.redact(F.col("text"))))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number and hash of its ids and the hash of what they decode to."""
    return bytebpe.digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: The stages' models and checksums are beyond SQL; tests hold the result against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

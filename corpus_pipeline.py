"""Corpus pipeline: quality classifier, n-gram Jaccard join, secret scans, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillpoint.llm import jaccard_join, packing, quality, secret_scan
from stillpoint.scratch import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one of the least doc_id stays."""
    return jaccard_join.one_of_each(docs, jaccard_join.Rule(shingle=5, percent=80))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows the text."""
    clean = secret_scan.redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return clean
    changed = F.when(F.col("text").isNotNull() & F.contains("text", F.lit(secret_scan.MARK)), F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: No SQL can say the resampling, the tokens or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage{k}")
    return docs

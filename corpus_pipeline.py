"""From raw documents to a training mixture: five stages over the documents table, each a decision of one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontam, mixing, secrets, simhash, toxicity
from brindle.llm.shared import Stash


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not call toxic."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, over five-word shingles."""
    return simhash.drop_near_duplicates(docs)


def free_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets redacted."""
    return secrets.redact_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target weights and shuffled."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("simhash near-dedup", one_of_each_group),
    ("benchmark decontamination", free_of_benchmarks),
    ("secret scan", without_secrets),
    ("mixing", mixed),
]

#: A fitted classifier, XXH64 fingerprints and connected components are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; all but the last write their table to the shared folder."""
    stash = Stash(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash.keep(docs, f"stage{i}")
            if i > 0:
                stash.drop(f"stage{i - 1}")
    return docs

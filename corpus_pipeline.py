"""The corpus pipeline: line rules, near-duplicates, benchmark leaks, secrets, then the mix of sources.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. run() writes each stage's rows and reads them back for the next one.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import decontaminate, minhash, mixing, quality_rules, secrets
from panelspark.llm.common import table
from panelspark.session import cut_lineage


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line rules, without their failing lines."""
    return quality_rules.rules_stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one with the smallest id."""
    return minhash.dedup_stage(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark table."""
    return decontaminate.decontaminate_stage(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.redact_stage(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(docs)


STAGES = [("quality rules", rules), ("near-duplicates", near_duplicates), ("benchmark decontamination", benchmark_leaks),
          ("secret scan", secret_scan), ("mixing", mix)]

# Near-duplicate components and the hashed draws of the mix have no SQL form; the tests compare
# the whole run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

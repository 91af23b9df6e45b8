"""A corpus pipeline: quality rules, near-dedup, decontamination, secret redaction, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.shipping import ship
from tessera.llm import bpe, common, decontaminate, minhash, quality_rules, secrets


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    ship(spark)
    return minhash.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts."""
    return secrets.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of ids and of the decoded text."""
    ship(spark)
    return bpe.encode(docs, bpe.default_tokenizer(), digest=True)


STAGES = [
    ("quality_rules", rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scan),
    ("bpe", encoding),
]

#: MinHash with components, the token merges and the randomness tests aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's input and what it staged by the way are deleted when its output is written."""
    docs, since = common.documents(spark, sf_dir), common.staged_so_far()
    for name, step in STAGES[:-1]:
        docs = common.settled(step(spark, docs, sf_dir), f"pipeline-{name}", since)
    return STAGES[-1][1](spark, docs, sf_dir)

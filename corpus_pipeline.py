"""A training corpus from ``documents``: five stages, each the work of one operator.

Every stage reads what the one before it kept, as written Parquet; its decisions take
effect in what it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from captionflow.llm import decontamination, packing, quality, secrets, simhash
from captionflow.llm.common import drop_inputs, drop_stage, stage, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that of the least id."""
    return simhash.keep_one_per_component(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    return secrets.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into token sequences; a row per piece."""
    return packing.packing_digest(packing.pack(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", pack_sequences),
]

#: The stages train a model and follow chains of links: SQL cannot express them. They
#: are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written before the next reads it. A stage's
    output, and what it had staged, goes when the next one's is written (the last stage
    takes what it needs of its input before it returns)."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        made = function(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            drop_stage(docs)
            return made
        after = stage(made, f"pipeline-{name}")
        drop_inputs(made)
        drop_stage(docs)
        docs = after
    return docs

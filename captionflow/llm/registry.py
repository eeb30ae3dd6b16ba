"""Queries over the test tables, one for each operator, and the pipeline.

Each runs its operator with production parameters over the whole table and returns
the full result; digests of spans and ids are derived from the operator's output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontamination, licenses, packing, pii, prefix_trie, quality, quality_rules, secrets, simhash, token_files,
               toxicity, url_filter, variants)
from ..session import ensure_checkpoint_dir
from .common import table
from .oracle_sql import ORACLE

RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` packed into sequences of at most 2048 tokens; a row per piece."""
    return packing.packing_digest(packing.pack(table(spark, sf_dir, "documents")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learnt from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow or block for every page: by its rule, else by its alias class."""
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and contained license templates of every document."""
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, in its text and in every encoded layer of it."""
    s = secrets.scan_documents(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans",
                    "n_unopened")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    s = pii.scan_documents(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that every document contains, as templates."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, plain rules and divergence from the language for every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "char_divergence", "word_divergence")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity categories of every document by a classifier chain."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of ``documents`` with its near words, form and root."""
    return variants.variant_forms(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of ``conversations`` with shared heads; a row per node."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), shared_heads=True)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as token-id files in the shared folder, read back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens",
                                                            F.crc32("ids").alias("ids_crc32"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline.py`` over ``documents``."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_packing, op2_quality_classifier, op3_url_filters, op4_license_scans, op5_simhash_near_dedup, op6_secret_scans,
    op7_pii, op8_benchmark_decontamination, op9_quality_rules, op10_toxicity,
    op11_spelling_variants, op12_prefix_trie, op13_token_files, pipeline)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

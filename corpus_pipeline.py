"""From documents to packed training sequences: five operators of `vectorloom.llm` in a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm import mixing, ngram_join, packing, quality, secret_scan
from vectorloom.llm.text import documents, fresh
from vectorloom.operators.sizing import settle_as_table
from vectorloom.session import scratch_path

NEAR = ngram_join.Spec(size=5, num=80)  # five words, a similarity of 0.8 or more


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.good_documents(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return ngram_join.distinct_documents(docs, spec=NEAR)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; columns named like those of the scan keep their values."""
    aside = {c: fresh(docs.columns, "_" + c) for c in docs.columns if c.lower() in ("blob", "spans", "row", "content")}
    rows = docs.withColumnsRenamed(aside)
    found = secret_scan.scan_versions(rows, scratch_path(spark, "secret-ledger"), path="doc_id")
    changed = {"text": secret_scan.redact(F.col("text"), F.col("spans"))}
    if "n_chars" in docs.columns:
        length = F.length(changed["text"]).cast("bigint")
        changed["n_chars"] = F.when(F.size("spans") > 0, length).otherwise(F.col("n_chars"))
    return found.select(*[changed.get(c, F.col(aside.get(c, c))).alias(c) for c in docs.columns])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.take(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("near_copies", without_near_copies),
    ("secrets", without_secrets),
    ("mixing", mixed_sources),
    ("packing", packed),
]

# Tokenizer ids, the estimate of the quality model and hashes of the mix cannot be stated in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = settle_as_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

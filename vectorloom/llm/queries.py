"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm import alignment, archive, conversation, disclosure, langid, lm_score, mixing, ngram_join, packing, quality, secret_scan, syncmers, toxicity
from vectorloom.llm.text import crc_remainder, documents
from vectorloom.operators.sizing import settle_as_table
from vectorloom.session import scratch_path
from vectorloom.sources import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as first versions, scanned into a ledger that starts empty."""
    rows = documents(spark, folder).select("doc_id", "text")
    ledger = scratch_path(spark, "secret-ledger")
    found = secret_scan.scan_versions(rows, ledger, path="doc_id").drop("text")
    base = secret_scan.only(F.col("spans"), secret_scan.BASE_RULES)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(rule.kind).alias(f"n_{rule.kind}") for rule in secret_scan.BASE_RULES],
        F.sha2(secret_scan.digest(base), 256).alias("base_sha256"),
        secret_scan.digest(F.col("spans")).alias("spans"),
    )


@query
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder).select("doc_id", "text", "source")
    return mixing.mix(rows).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(documents(spark, folder))


@query
def op4_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Write every page to packages in the shared folder, then read all records back."""
    plan = archive.plan_records(table(spark, folder, "pages"), "page_id", "html", "url")
    packages = settle_as_table(archive.write_packages(plan, scratch_path(spark, "archives")), "packages")
    spots = archive.locate(packages.repartition(spark.sparkContext.defaultParallelism))
    spots = settle_as_table(spots, "spots").repartition(spark.sparkContext.defaultParallelism * 2)
    return archive.read_records(spots).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op5_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.compare_with_next(documents(spark, folder))


@query
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(documents(spark, folder).select("doc_id", "text"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *base, "base_failed", "kept", "votes", "posterior")


@query
def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(documents(spark, folder))


@query
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder).select("doc_id", "text", "lang")
    held_out = crc_remainder("doc_id", 3) == 1
    model = langid.train(langid.sample(rows.where(~held_out), "doc_id", "text", "lang"))
    found = langid.identify(rows, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder).select("doc_id", "text")
    held_out = crc_remainder("doc_id", 4) == 2
    model = toxicity.train(toxicity.sample(rows, table(spark, folder, "labels").where(~held_out), "doc_id", "text", "toxic"))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return toxicity.score(rows, model).select("doc_id", held_out.alias("held_out"), "score", predicted)


@query
def op10_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder).select("doc_id", "text")
    held_out = crc_remainder("doc_id", 5) == 1
    scored = lm_score.score_texts(rows, ~held_out)
    return scored.withColumn("held_out", held_out)


@query
def op11_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = disclosure.sanitise(documents(spark, folder).select("doc_id", "text"), ["doc_id"])
    count = lambda kind: F.size(disclosure.only(F.col("spans"), [kind])).cast("bigint")
    base = disclosure.digest(disclosure.only(F.col("spans"), disclosure.KINDS))
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in disclosure.KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        disclosure.digest(F.col("spans")).alias("spans"),
    )


@query
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(documents(spark, folder), ["doc_id"], groups=False)


@query
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return conversation.repaired_totals(conversation.damaged(rows), rows)

"""The operators of this package as queries over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import chat_format, decontamination, filter_audit, jaccard_join, license_scan, packing, periodic_runs, pii
from shelfline.llm import quality_classifier, quality_rules, substring_dedup, token_files, warc
from shelfline.llm.shipping import ship_package
from shelfline.session import discard_at_exit, fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, folder, "documents"))


@_query
def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = fresh_path(spark, "token-files")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_token_files(_table(spark, folder, "documents"), files, tokenizer, end_id=2)
    return token_files.read_documents(spark, files)


@_query
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@_query
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup.digested(substring_dedup.without_repeats(_table(spark, folder, "documents")))
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query
def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    ruled = quality_rules.judged(_table(spark, folder, "documents"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


@_query
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, folder, "documents"))


@_query
def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(_table(spark, folder, "documents"))


# Tools a conversation may call; the given tables hold no calls of others.
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculate": {"expression": ("string", True)},
}


@_query
def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat_format.formatted(_table(spark, folder, "conversations"), TOOLS)


@_query
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(filter_audit.masks(_table(spark, folder, "documents")), _table(spark, folder, "labels"))


@_query
def op12_warc_captures(spark: SparkSession, folder: str) -> DataFrame:
    archives = fresh_path(spark, "archives")
    discard_at_exit(spark, archives)
    warc.write_archives(_table(spark, folder, "pages"), archives)
    found = warc.page_captures(spark, archives)
    return found.select("page_id", "response.payload_bytes", "response.payload_digest", "response.record_type", F.col("refers_to_page").alias("refers_to"))


def echoed(documents: DataFrame) -> DataFrame:
    """The documents; in those whose id's checksum ends in 0, the words from
    place `a` on become repeats of the `p` words that stand there."""
    plain = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.crc32(F.col("doc_id").cast("long").cast("string")).alias("h"),
    )
    chosen = plain.withColumn("words", F.expr("CASE WHEN h % 10 = 0 THEN filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), word -> word <> '') END"))
    numbered = chosen.withColumn("n", F.size("words").cast("long")).withColumn("g", F.expr("h DIV 10"))
    placed = numbered.withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END")).withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    echo = F.expr("array_join(transform(sequence(0L, n - 1), i -> words[CAST(IF(i < a, i, a + (i - a) % p) AS INT)]), ' ')")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), echo).otherwise(F.col("text")).alias("text"))


@_query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.digested(periodic_runs.periodic_runs(echoed(_table(spark, folder, "documents"))))

"""Registered queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import (
    chat, checks, decontaminate, imatch, jaccard, licenses, pieces, quality, ranking, repair, sharding, substrings, tokens, urls,
)

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHARDS = [f"shard-{i:03d}" for i in range(128)]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_maglev_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_read(spark, sf_dir, "documents"), "doc_id", SHARDS)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_read(spark, sf_dir, "documents")).drop("spans")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN
    return tokens.token_counts(_read(spark, sf_dir, "documents"), path, pattern)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECE_BPE)
    done = pieces.decode(pieces.encode(_read(spark, sf_dir, "documents"), path), path)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(_read(spark, sf_dir, "documents"), size=3, num=90, den=100).drop("node")


def op7_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(_read(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(_read(spark, sf_dir, "documents"), 50).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).drop("row")


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    return repair.with_all(repair.report(repair.repaired(repair.damaged(rows))), rows)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), 10)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_turns(_read(spark, sf_dir, "conversations"), -1, [(r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")])
    return chat.digests(chat.formatted(rows))


QUERIES = {
    f.__name__: f
    for f in [
        op1_maglev_sharding, op2_benchmark_decontamination, op3_license_scan, op4_token_counts, op5_sentencepiece,
        op6_ngram_jaccard_join, op7_imatch_fingerprints, op8_suffix_array_dedup, op9_quality_classifier, op10_url_templates,
        op11_conversation_repair, op12_ranked_search, op13_chat_format,
    ]
}
CHECKS = {
    "op2_benchmark_decontamination": checks.CONTAINMENT, "op10_url_templates": checks.TEMPLATES, "op11_conversation_repair": checks.REPAIR,
    "op12_ranked_search": checks.RANKED, "op13_chat_format": checks.CHAT,
}

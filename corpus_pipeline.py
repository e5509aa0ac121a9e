"""Corpus pipeline: documents pass the stages in order, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import decontaminate, jaccard, pieces, quality, substrings
from concord.llm.queries import PIECE_BPE
from concord.llm.tables import written

#: Names a row by its id and text, so that ids may be null or stand on several rows. Equal rows share it.
ROW = "__row__"
#: Bytes of a repeated passage that is cut out; license lines and greetings are shorter.
PASSAGE = 100


def _named(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.xxhash64("doc_id", "text"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, trained on the labels of ``sf_dir``; an empty table stays empty."""
    rows = _named(docs)
    scores = quality.quality_scores(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), row=ROW)
    good = scores.where("predicted = 1").select(F.col("row").alias(ROW)).distinct()
    return rows.join(good, ROW, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id. Repeated rows are one document."""
    rows = _named(docs)
    groups = jaccard.jaccard_groups(rows, size=5, num=80, den=100, ident=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    named = rows.select(ROW, "doc_id").join(groups.distinct(), ROW)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("first")
    kept = named.groupBy("component_id").agg(first).select(F.col(f"first.{ROW}").alias(ROW))
    return rows.join(kept, ROW, "left_semi").dropDuplicates([ROW]).select(*[F.col(f"`{c}`") for c in docs.columns])


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without passages of PASSAGE bytes that also stand in one of smaller id; cut characters go whole."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    told = docs.withColumn(ROW, F.col("text").isNull())
    done = substrings.without_repeats(told, PASSAGE, carry=[*others, ROW])
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    text = F.when(F.col("n_removed") > 0, F.regexp_replace(text, "�", "")).otherwise(text)
    done = done.withColumn("_text", F.when(~F.col(f"rest.c{len(others)}"), text))
    kinds = dict(docs.dtypes)

    def column(name: str):
        if name == "doc_id":
            return F.col("doc_id").cast(kinds[name]).alias(name)
        if name == "text":
            return F.col("_text").alias(name)
        value = F.col(f"rest.c{others.index(name)}")
        if name == "n_chars":
            value = F.when(F.col("n_removed") > 0, F.length("_text").cast(kinds[name])).otherwise(value)
        return value.alias(name)

    return done.select(*[column(c) for c in docs.columns])


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item of ``sf_dir``."""
    rows = _named(docs)
    found = decontaminate.contained(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ident=ROW)
    bad = found.select(F.col("doc_id").alias(ROW)).distinct()
    return rows.join(bad, ROW, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every document."""
    path = public_tokenizers.path(PIECE_BPE)
    done = pieces.decode(pieces.encode(docs, path), path)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("suffix_array_dedup", suffix_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("sentencepiece", pieces_stage),
]

#: Tokenizing, suffix sorting and a trained classifier have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

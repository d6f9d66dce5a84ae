"""The queries of the training-data operators, one for each, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, html_graph, line_dedup, mixing, pii, quality, repetition, signature_trees, token_shards
from .common import scratch_path, table

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "shards")
    token_shards.write(table(spark, sf_dir, "documents"), path, WORD_TOKENIZER)
    return token_shards.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signature_trees.component_table(table(spark, sf_dir, "documents"), signature_trees.Join(words=4, percent=85))
    return found.select("doc_id", "n_shingles", "component_id", "class_size")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(table(spark, sf_dir, "documents"))


def _only(i: int) -> Callable[[Column], Column]:
    return lambda x: F.when(x == i, x)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.detect(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    orders = F.transform("base", lambda x: x["order"])
    counts = [F.size(F.array_compact(F.transform(orders, _only(i)))).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.BASE)]
    return spans.withColumn("base", base).select("doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", "n_near", F.char_length("text").cast("long").alias("n_chars_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_graph.extract_pages(table(spark, sf_dir, "pages"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.component_table(table(spark, sf_dir, "embeddings"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_token_shards, op2_source_mix, op3_ngram_jaccard, op4_quality_rules, op5_personal_data, op6_byte_bpe, op7_line_dedup, op8_main_text, op9_embedding_dedup, op10_quality_classifier]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {}

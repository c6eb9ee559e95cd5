"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from duovox.llm import bpe, divergence, huffman, infill, lines, media, near, packing, pii, quality, repeats, secrets, topk
from duovox.llm.common import table


def byte_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def word_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.shard_digest(table(spark, sf_dir, "documents", "doc_id", "text"), byte_tokenizer())


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_spans(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents", "doc_id", "text"), byte_tokenizer())


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.link_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), word_tokenizer())


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents", "lang", "source", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_shards": op3_token_shards,
    "op4_line_dedup": op4_line_dedup,
    "op5_top_k": op5_top_k,
    "op6_private_data": op6_private_data,
    "op7_bpe": op7_bpe,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_packing": op9_packing,
    "op10_media": op10_media,
    "op11_infill": op11_infill,
    "op12_repeats": op12_repeats,
    "op13_source_divergence": op13_source_divergence,
    "pipeline": pipeline,
}
SQL: dict[str, str] = {"op4_line_dedup": lines.SQL, "op5_top_k": topk.SQL, "op11_infill": infill.SQL, "op12_repeats": repeats.SQL, "op13_source_divergence": divergence.SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL

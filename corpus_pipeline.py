"""A training-data pipeline over documents: quality, shared lines, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duovox.llm import lines, near, packing, quality, secrets
from duovox.llm.common import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labelled ones among docs that aren't held out.

    Rows stay or go by their own text, whole and of any length: repeated rows, and rows that share an id, alike where their texts are. Null and
    empty texts get the score of no words. Null ids have no label, so nothing is learned from them. Without labelled documents nothing
    is rejected; an empty table stays empty. Other columns, of any name, stay as they are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.accepted(docs, labels)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the lines that three or more documents share; n_chars follows the text.

    Documents are told apart by id: repeated rows of one id count once and are treated alike, rows with a null id are one document, the first of all.
    Null texts stay null. Lines of any length are hashed whole. An empty table stays empty; other columns stay as they are, those named
    n_lines and n_dropped too.
    """
    aside = {c: _free(f"own_{c}", docs.columns) for c in ("n_lines", "n_dropped") if c in docs.columns}
    kept = lines.without_shared_lines(docs.withColumnsRenamed(aside)).drop("n_lines", "n_dropped")
    kept = kept.withColumnsRenamed({new: old for old, new in aside.items()})
    return kept.withColumn("n_chars", counted(docs)).select(*docs.columns)


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of least doc_id, of each group of near duplicates. A document without words is a group of its own.

    Rows that repeat a doc_id are one document: the least row of a kept id stays. Rows with a null doc_id are compared with each
    other as exact texts only, and the least row of each text stays (all rows of texts without words).
    """
    kept = near.link_components(docs).where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    once, many = (docs.join(kept.where(f"n {sign} 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns) for sign in "=>")
    words = F.coalesce(F.col("text").rlike(r"[^ \t\n\r\x0b\f]"), F.lit(False))
    no_id = docs.where("doc_id IS NULL")
    return no_id.where(~words).union(least_row(no_id.where(words), "text")).union(once).union(least_row(many, "doc_id"))


def least_row(docs: DataFrame, key: str) -> DataFrame:
    """One row for each key, with partial minima on the map side."""
    rest = [c for c in docs.columns if c != key]
    return docs.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(*[F.col(c) if c == key else F.col("_row")[c].alias(c) for c in docs.columns])


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked; n_chars follows the text.

    Every row stays, with all other columns, whatever its id; null and empty texts stay as they are, repeated rows stay repeated, long texts are
    scanned whole, an empty table stays empty.
    """
    return secrets.redacted(docs).withColumn("n_chars", counted(docs)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2048 tokens.

    Every row is a document of its own, repeated ones and those with a null id too; null and empty texts have the end id alone; long texts are cut
    into pieces of 2048. Other columns end here; an empty table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def counted(docs: DataFrame):
    """Code points of the text; a null text keeps the count that it has."""
    return F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("near duplicates", near_stage), ("secret scan", secret_stage), ("packing", packing_stage)]
#: The models of the first and fourth stage and the tokenizer of the last have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    base = shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}")
    return docs

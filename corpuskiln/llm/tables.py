"""The test tables as the operators take them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, settle, table


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that are no parents; a null flag counts as no parent."""
    return table(spark, sf_dir, "chunks").where(~F.coalesce("is_parent", F.lit(False)))


def scanned_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and text blocks of scanned PDFs: ``record_type, record_id, title, heading, text``. Heading blocks, tables and figures have no page noise."""
    docs = table(spark, sf_dir, "pdf_documents").where("scanned").groupBy("source_id").agg(F.max("title").alias("doc_title"))
    docs = broadcast_if_small(settle(docs, "scanned"), 120)
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunk").alias("record_type"), F.col("chunk_id").alias("record_id"), "source_id", "title", F.col("section").alias("heading"), "text")
    blocks = table(spark, sf_dir, "blocks").where(~F.coalesce("is_heading", F.lit(False)) & F.coalesce("block_type", F.lit("text")).eqNullSafe("text")).select(
        F.lit("block").alias("record_type"), F.col("block_id").cast("string").alias("record_id"), "source_id", F.lit(None).cast("string").alias("title"), "heading", "text"
    )
    units = chunks.union(blocks).join(docs, "source_id")
    return units.select("record_type", "record_id", F.coalesce("doc_title", "title").alias("title"), "heading", "text")


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("text").union(table(spark, sf_dir, "blocks").select("text"))

"""Schemas of the engine's tables and the derived chunk id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "1.0"

CHUNK = T.StructType([
    T.StructField("chunk_id", T.StringType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("source_type", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("url", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("is_parent", T.BooleanType()),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("overlap_tokens", T.IntegerType()),
    T.StructField("extra", T.StringType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

VECTOR = T.StructType([
    T.StructField("chunk_id", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType(), False)),
    T.StructField("model", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

#: Columns of a hit of one leg (with a score) and of the fused search.
LEG_HIT = ["chunk_id", "text", "section", "source_id", "page", "url", "parent_id", "chunk_index", "title", "lang"]
SEARCH_HIT = [*LEG_HIT, "rrf_score", "dense_rank", "lexical_rank"]


def chunk_id(source_type: Column, source_id: Column, chunk_index: Column, is_parent: Column) -> Column:
    """First 16 hex digits of sha256 over the identifying fields; it does not depend on the text."""
    kind = F.when(F.coalesce(is_parent, F.lit(False)), "parent").otherwise("child")
    joined = F.concat_ws("\x1f", source_type, source_id, chunk_index.cast("string"), kind)
    return F.substring(F.sha2(joined, 256), 1, 16)


def conform(df: DataFrame, schema: T.StructType = CHUNK) -> DataFrame:
    """Additive migration: unknown columns go, missing ones come as null, a null chunk_index becomes 0."""
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    out = df.select(*cols)
    return out.withColumn("chunk_index", F.coalesce("chunk_index", F.lit(0))) if "chunk_index" in schema.fieldNames() else out

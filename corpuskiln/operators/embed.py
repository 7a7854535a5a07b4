"""Hashing embedding: md5 bucket per word, 1 + ln(count), unit length."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _hasher(dim: int):
    """Text -> lists of (bucket, weight) in order of the bucket, in Arrow batches. A vector needs its own text only, so nothing is
    shuffled; the buckets of words met before are kept by the task, up to a million."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[str, int] = {}
        find = re.compile("[a-z0-9]+").findall
        for batch in batches:
            if len(at) > 1_000_000:
                at.clear()
            sizes, buckets, counts = [], [], []
            for t in batch.column(1).to_pylist():
                n: dict[int, int] = {}
                for w in find(t.lower()) if t else ():
                    b = at.get(w)
                    if b is None:
                        b = at[w] = int(hashlib.md5(w.encode()).hexdigest(), 16) % dim
                    n[b] = n.get(b, 0) + 1
                own = sorted(n)
                sizes.append(len(own))
                buckets += own
                counts += [n[b] for b in own]
            sizes = np.array(sizes, dtype=np.int64)
            raw = 1 + np.log(np.array(counts, dtype=np.float64))
            row = np.repeat(np.arange(len(sizes)), sizes)
            weight = raw / np.sqrt(np.bincount(row, raw * raw, minlength=len(sizes)))[row]
            pairs = pa.StructArray.from_arrays([pa.array(buckets, pa.int32()), pa.array(weight)], names=["bucket", "weight"])
            some = np.flatnonzero(sizes)
            offsets = np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.ListArray.from_arrays(pa.array(offsets), pairs)], names=["id", "vector"])

    return run


def hashed(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", dim: int = 1024) -> DataFrame:
    """``id, vector`` with the buckets and weights of every text that has a word, one row a text."""
    kind = df.schema[id_col].dataType.simpleString()
    v = df.select(F.col(id_col), F.col(text_col)).mapInArrow(_hasher(dim), f"id {kind}, vector array<struct<bucket:int,weight:double>>")
    return v.withColumnRenamed("id", id_col)


def sparse(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", dim: int = 1024) -> DataFrame:
    """``id, bucket, weight``: the same with a row for each bucket."""
    return hashed(df, id_col, text_col, dim).select(id_col, F.explode("vector").alias("v")).select(id_col, "v.bucket", "v.weight")


def dense(vectors: DataFrame, id_col: str = "chunk_id", dim: int = 1024) -> DataFrame:
    """Hashed vectors as ``id, embedding`` arrays of ``dim`` floats."""
    m = vectors.select(id_col, F.map_from_entries("vector").alias("m"))
    at = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)).cast("float"))
    return m.select(id_col, at.alias("embedding"))


class Embedder:
    """``hashing``, or a model: a function from a list of texts to a list of vectors, run on Arrow batches."""

    def __init__(self, backend: str = "hashing", dim: int = 1024, encode: Callable[[list[str]], list] | None = None):
        if backend != "hashing" and encode is None:
            raise ValueError(f"the embedding backend {backend!r} needs an encode function")
        self.backend, self.dim, self.encode = backend, dim, encode

    def transform(self, df: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
        if self.encode is None:
            return dense(hashed(df, id_col, text_col, self.dim), id_col, self.dim)
        encode = self.encode

        @F.pandas_udf("array<float>")
        def model(texts: pd.Series) -> pd.Series:
            return pd.Series([[float(x) for x in v] for v in encode(texts.fillna("").tolist())])

        return df.select(id_col, model(F.col(text_col)).alias("embedding"))


def save_store(chunks: DataFrame, vectors: DataFrame, path: str) -> None:
    """A store in files: the chunks and their vectors as two tables below ``path``."""
    for name, df in (("chunks", chunks), ("vectors", vectors)):
        df.write.option("compression", "zstd").parquet(f"{path.rstrip('/')}/{name}")


def load_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(chunks, vectors)`` of a store in files."""
    return spark.read.parquet(f"{path.rstrip('/')}/chunks"), spark.read.parquet(f"{path.rstrip('/')}/vectors")

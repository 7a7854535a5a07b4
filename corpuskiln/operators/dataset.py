"""Sets for tuning: combined chunks, instruction rows, deterministic splits."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Fixed value: the instruction of a chunk, which trained models were given.
INSTRUCTION = "Based on the documentation, explain: %s."


def instruction_rows(chunks: DataFrame, question: Callable[[str], str | None] | None = None) -> DataFrame:
    """``instruction, input, output, meta`` for each child. ``question`` is a hook that gives a text its instruction; where it gives none, the template stands."""
    about = F.coalesce("section", "title", F.lit("the source material"))
    asked = F.format_string(INSTRUCTION, about)
    if question is not None:

        @F.pandas_udf("string")
        def own(texts: pd.Series) -> pd.Series:
            return pd.Series([question(t) if t else None for t in texts], dtype=object)

        asked = F.coalesce(own("text"), asked)
    meta = F.to_json(F.struct("chunk_id", "source_id", "page", "url"), {"ignoreNullFields": "false"})
    return chunks.where(~F.coalesce("is_parent", F.lit(False))).select("chunk_id", asked.alias("instruction"), F.lit("").alias("input"), F.col("text").alias("output"), meta.alias("meta"))


def split(rows: DataFrame, key: str = "chunk_id", share: float = 0.1) -> DataFrame:
    """``split``: ``val`` for the int(n * share) rows first in hash order, else ``train``.

    The border is found by counting hash prefixes; only the border's prefix is ordered row by row.
    """
    from pyspark.sql import Window

    h = rows.withColumn("__h", F.md5(F.col(key).cast("string"))).withColumn("__p", F.substring("__h", 1, 3))
    counts = h.groupBy("__p").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(Window.orderBy("__p"))).withColumn("want", F.floor(F.sum("k").over(Window.partitionBy()) * share))
    p = h.join(F.broadcast(counts), "__p")
    r = F.row_number().over(Window.partitionBy("__p").orderBy("__h", key)) + F.col("upto") - F.col("k")
    return p.withColumn("split", F.when(r <= F.col("want"), "val").otherwise("train")).drop("__h", "__p", "k", "upto", "want")


def kinds(chunks: DataFrame) -> DataFrame:
    """``kind``: parents, tables, figures or prose, each chunk in one."""
    b = F.coalesce(F.get_json_object("extra", "$.block_type"), F.lit("text"))
    return chunks.withColumn("kind", F.when(F.coalesce("is_parent", F.lit(False)), "parents").when(b == "table", "tables").when(b == "figure", "figures").otherwise("prose"))


def write_sets(chunks: DataFrame, path: str, share: float = 0.1, question: Callable[[str], str | None] | None = None) -> dict[str, int]:
    """``corpus.jsonl`` of all chunks, and ``train.jsonl`` and ``val.jsonl`` of the instruction rows, as folders below ``path``; their row counts."""
    from ..session import settle
    from ..sources.files import write_jsonl

    root = path.rstrip("/")
    write_jsonl(chunks, f"{root}/corpus.jsonl")
    rows = settle(split(instruction_rows(chunks, question), share=share), "sets")
    counts = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    for name in ("train", "val"):
        write_jsonl(rows.where(F.col("split") == name).drop("chunk_id", "split"), f"{root}/{name}.jsonl")
    return {name: counts.get(name, 0) for name in ("train", "val")}

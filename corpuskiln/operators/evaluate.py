"""Retrieval quality against labelled questions."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECALL_AT = (5, 10, 20, 50)


def load_golden(rows: DataFrame) -> DataFrame:
    """Golden rows; one without labels is an error."""
    bad = rows.where(F.coalesce(F.size("relevant_chunk_ids"), F.lit(0)) <= 0).limit(1).count()
    if bad:
        raise ValueError("a golden row has no relevant chunk")
    return rows


def per_question(ranked: DataFrame, golden: DataFrame) -> DataFrame:
    """A row for each golden question: recall at several depths, reciprocal rank and binary nDCG to 10, first hit and what each leg found.

    ``ranked``: ``query_id, chunk_id, rank, dense_rank, lexical_rank``; ``golden``: ``query_id, relevant_chunk_ids, stratum, block_type, source_type``.
    """
    labels = golden.select("query_id", F.explode(F.array_distinct("relevant_chunk_ids")).alias("chunk_id"), F.lit(True).alias("rel"))
    r = ranked.join(labels, ["query_id", "chunk_id"], "left")
    rel = F.coalesce("rel", F.lit(False))
    m = r.groupBy("query_id").agg(
        F.count("*").alias("candidates"),
        *[F.count_if(rel & (F.col("rank") <= k)).alias(f"hit_{k}") for k in RECALL_AT],
        F.min(F.when(rel, F.col("rank"))).alias("first_hit_rank"),
        F.sum(F.when(rel & (F.col("rank") <= 10), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.count_if(rel & F.col("dense_rank").isNotNull()).alias("dense_leg_hits"),
        F.count_if(rel & F.col("lexical_rank").isNotNull()).alias("lexical_leg_hits"),
    )
    g = golden.withColumn("n_rel", F.size(F.array_distinct("relevant_chunk_ids"))).join(m, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(F.col("n_rel"), F.lit(1)), F.lit(10))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    share = lambda c: F.when(F.col("n_rel") > 0, F.coalesce(c, F.lit(0)) / F.col("n_rel")).otherwise(0.0)
    return g.select(
        "query_id", "stratum", "block_type", "source_type", F.coalesce("candidates", F.lit(0)).alias("candidates"),
        *[share(F.col(f"hit_{k}")).alias(f"recall_{k}") for k in RECALL_AT],
        F.when(F.col("first_hit_rank") <= 10, 1.0 / F.col("first_hit_rank")).otherwise(0.0).alias("mrr_10"),
        F.when(F.col("n_rel") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg_10"),
        "first_hit_rank", F.coalesce("dense_leg_hits", F.lit(0)).alias("dense_leg_hits"), F.coalesce("lexical_leg_hits", F.lit(0)).alias("lexical_leg_hits"),
    )


METRICS = [*(f"recall_{k}" for k in RECALL_AT), "mrr_10", "ndcg_10"]


def report(rows: DataFrame) -> DataFrame:
    """``dimension, segment`` and the mean metrics: all questions and by stratum, block_type and source_type, in one pass."""
    dims = ["stratum", "block_type", "source_type"]
    g = rows.groupingSets([[], *[[d] for d in dims]], *dims).agg(
        F.grouping_id(*dims).alias("gid"), F.count("*").alias("n"), *[F.round(F.avg(m), 4).alias(m) for m in METRICS], F.round(F.avg("candidates"), 1).alias("mean_candidates"),
        F.sum("dense_leg_hits").alias("dense_leg_hits"), F.sum("lexical_leg_hits").alias("lexical_leg_hits"), F.count("first_hit_rank").alias("found_any"),
    )
    name = F.when(F.col("gid") == 7, "overall").when(F.col("gid") == 3, "stratum").when(F.col("gid") == 5, "block_type").otherwise("source_type")
    segment = F.when(F.col("gid") == 7, "").when(F.col("gid") == 3, F.col("stratum")).when(F.col("gid") == 5, F.col("block_type")).otherwise(F.col("source_type"))
    return g.select(name.alias("dimension"), segment.alias("segment"), "n", *METRICS, "mean_candidates", "dense_leg_hits", "lexical_leg_hits", "found_any")


def diff(base: DataFrame, new: DataFrame) -> DataFrame:
    """``dimension, segment`` and the change of each metric over segments that both reports have."""
    b = base.select("dimension", "segment", *[F.col(m).alias(f"b_{m}") for m in METRICS])
    return new.join(b, ["dimension", "segment"]).select("dimension", "segment", *[F.round(F.col(m) - F.col(f"b_{m}"), 4).alias(m) for m in METRICS])


def write_report(rows: DataFrame, path: str, meta: dict | None = None) -> None:
    """The report as one JSON file of the four dimensions and ``_meta``: a row for each segment, few by nature."""
    own = F.map_from_entries(F.collect_list(F.struct("segment", F.struct("n", *METRICS, "mean_candidates", "dense_leg_hits", "lexical_leg_hits", "found_any").alias("m"))))
    per = rows.groupBy("dimension").agg(own.alias("segments"))
    out = per.agg(F.map_from_entries(F.collect_list(F.struct("dimension", "segments"))).alias("report"), F.lit(json.dumps(meta or {}, sort_keys=True)).alias("_meta"))
    out.coalesce(1).write.mode("overwrite").json(path)


def judged(rows: DataFrame, judge: Callable[[str, str, list[str]], dict[str, float]], metrics: list[str]) -> DataFrame:
    """Scores of a model's judgement of (question, answer, contexts) added to ``question, answer, contexts``, a double for each metric; a failure gives nulls."""
    kind = "struct<" + ",".join(f"`{m}`:double" for m in metrics) + ">"

    @F.pandas_udf(kind)
    def run(question: pd.Series, answer: pd.Series, contexts: pd.Series) -> pd.DataFrame:
        def one(q, a, c):
            try:
                got = judge(q, a, list(c) if c is not None else [])
            except Exception:  # noqa: BLE001
                got = {}
            return [got.get(m) for m in metrics]

        return pd.DataFrame([one(*x) for x in zip(question, answer, contexts)], columns=metrics, dtype="float64")

    return rows.withColumn("__j", run("question", "answer", "contexts")).select(*rows.columns, *[F.col(f"__j.{m}").alias(m) for m in metrics])

"""Fusion of ranked runs, hybrid search, parent expansion and reranking, for all queries in one plan."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LEG_HIT, SEARCH_HIT
from ..session import broadcast_if_small, settle
from . import dense, embed, lexical


def rrf(runs: DataFrame, rrf_k: int = 60) -> DataFrame:
    """``query_id, chunk_id, rrf_score`` over runs ``query_id, chunk_id, rank`` with ranks from 1: the sum of 1 / (k + rank)."""
    return runs.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("rrf_score"))


def fuse(dense_hits: DataFrame, lexical_hits: DataFrame, rrf_k: int = 60) -> DataFrame:
    """Two legs in one aggregation instead of a full outer join: ``query_id, chunk_id, rrf_score, dense_rank, lexical_rank``."""
    both = dense_hits.select("query_id", "chunk_id", F.col("rank").alias("d"), F.lit(None).cast("int").alias("l")).union(lexical_hits.select("query_id", "chunk_id", F.lit(None).cast("int"), "rank"))
    one = both.groupBy("query_id", "chunk_id").agg(F.min("d").alias("dense_rank"), F.min("l").alias("lexical_rank"))
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    return one.withColumn("rrf_score", F.round(part("dense_rank") + part("lexical_rank"), 9))


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the columns of their rows. Hits are few beside the rows, so that they are written and sent to them where a count allows."""
    return broadcast_if_small(settle(hits, "hits"), 200).join(chunks.select(*LEG_HIT), "chunk_id")


def search_chunks(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, k_dense: int = 20, k_lexical: int = 20, k_final: int = 6, rrf_k: int = 60, source_type: str | None = None, source_id: str | None = None, prefilter: bool = False) -> DataFrame:
    """Hybrid search: ``query_id`` and the SEARCH_HIT columns, with ``final_rank``.

    The dense top-k is taken before the filters (with prefilter, after them); the lexical leg filters first. ``vectors`` and
    ``query_vectors`` have hashed vectors (``vector``) or an ``embedding`` array.
    """
    own = chunks.where(~F.coalesce("is_parent", F.lit(False)))
    if source_type is not None:
        own = own.where(F.col("source_type") == source_type)
    if source_id is not None:
        own = own.where(F.col("source_id") == source_id)
    if prefilter:
        vectors = vectors.join(own.select("chunk_id"), "chunk_id", "left_semi")
    top = dense.sparse_topk(vectors, query_vectors, k_dense) if "vector" in vectors.columns else dense.dense_topk(vectors, query_vectors, k_dense)
    fused = fuse(top.join(own.select("chunk_id"), "chunk_id", "left_semi"), lexical.lexical_topk(own, queries, k_lexical), rrf_k)
    best = dense.ranked(fused, k_final, "rrf_score", True).withColumnRenamed("rank", "final_rank")
    return hydrate(best, chunks).select("query_id", *SEARCH_HIT, "final_rank")


def fuse_variants(hits: DataFrame, k_final: int, rrf_k: int = 60) -> DataFrame:
    """Runs of several wordings of a query (``query_id, variant_no, chunk_id, final_rank``) into one."""
    runs = hits.select("query_id", "chunk_id", F.col("final_rank").alias("rank"))
    return dense.ranked(rrf(runs, rrf_k), k_final, "rrf_score", True)


def rerank(hits: DataFrame, k: int, predict: Callable[[list[tuple[str, str]]], list[float]] | None = None) -> DataFrame:
    """The k best hits by a model's score of (question, text) pairs; without a model, by the share of the question's words the text holds.

    ``hits`` has ``query_id, question, chunk_id, text``.
    """
    if predict is None:
        q = F.array_distinct(lexical.terms(F.col("question")))
        scored = hits.withColumn("rerank_score", F.round(F.size(F.array_intersect(q, lexical.terms(F.col("text")))) / F.greatest(F.size(q), F.lit(1)), 6))
    else:

        @F.pandas_udf("double")
        def score(question: pd.Series, text: pd.Series) -> pd.Series:
            return pd.Series([float(x) for x in predict(list(zip(question.tolist(), text.tolist())))])

        scored = hits.withColumn("rerank_score", score("question", "text"))
    return dense.ranked(scored, k, "rerank_score", True)


def expand_parents(hits: DataFrame, chunks: DataFrame, max_chars: int) -> DataFrame:
    """``query_id, chunk_id, text, rank``: the parent's text in place of the child's, the first hit of each parent only, as long as the
    characters fit (the first hit always). A hit whose parent is missing keeps its own text.

    ``hits`` has ``query_id, chunk_id, parent_id, text, rank``.
    """
    parents = chunks.where("is_parent").select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text"))
    h = hits.join(parents, "parent_id", "left").withColumn("family", F.when(F.col("parent_text").isNotNull(), F.col("parent_id")).otherwise(F.col("chunk_id")))
    one = h.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "family").orderBy("rank"))).where("r = 1").withColumn("text", F.coalesce("parent_text", "text"))
    w = Window.partitionBy("query_id").orderBy("rank")
    run = one.withColumn("chars", F.sum(F.length("text")).over(w)).withColumn("n", F.row_number().over(w))
    # lengths are positive, so the first overflow ends the list
    return run.where((F.col("n") == 1) | (F.col("chars") <= max_chars)).select("query_id", "chunk_id", "text", "rank")


def retrieve(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, variants: DataFrame | None = None, k_dense: int = 60, k_lexical: int = 60, k_candidates: int | None = None, k_final: int = 6, max_chars: int = 12288, predict=None, reranking: bool = False) -> DataFrame:
    """Wordings, search for each, fusion of their runs, optional reranking, parent expansion.

    ``queries`` has ``query_id, text``; ``variants`` has ``query_id, variant_no, text`` with the query itself as 0. The candidate
    pool is k_dense + k_lexical unless given.
    """
    pool = k_candidates or k_dense + k_lexical
    v = variants if variants is not None else queries.withColumn("variant_no", F.lit(0))
    runs = v.select(F.concat_ws("\x1f", F.col("query_id").cast("string"), F.col("variant_no").cast("string")).alias("query_id"), "text")
    qv = embed.hashed(runs, "query_id")
    hits = search_chunks(chunks, vectors, runs, qv, k_dense, k_lexical, pool)
    kind = queries.schema["query_id"].dataType
    hits = hits.withColumn("query_id", F.substring_index("query_id", "\x1f", 1).cast(kind))
    best = fuse_variants(hits, pool if reranking else k_final)
    found = hydrate(best, chunks)
    if reranking:
        found = rerank(found.drop("rank").join(queries.select("query_id", F.col("text").alias("question")), "query_id"), k_final, predict)
    return expand_parents(found, chunks, max_chars)


def retrieve_files(chunks: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, k_dense: int = 60, k_lexical: int = 60, k_final: int = 6, max_chars: int = 12288, predict=None, reranking: bool = False, expand: bool = True) -> DataFrame:
    """Retrieval over chunk files, without a store: BM25 over the children, with a dense leg if there are vectors, fused; optional reranking
    and parent expansion. ``query_id, chunk_id, text, rank``."""
    own = chunks.where(~F.coalesce("is_parent", F.lit(False)))
    runs = lexical.bm25_topk(own, queries, k_lexical).select("query_id", "chunk_id", "rank")
    if vectors is not None:
        top = (dense.sparse_topk if "vector" in vectors.columns else dense.dense_topk)(vectors.join(own.select("chunk_id"), "chunk_id", "left_semi"), query_vectors, k_dense)
        runs = runs.union(top.select("query_id", "chunk_id", "rank"))
    pool = max(k_dense, k_lexical)
    found = hydrate(dense.ranked(rrf(runs), pool if reranking else k_final, "rrf_score", True), chunks)
    if reranking:
        found = rerank(found.drop("rank").join(queries.select("query_id", F.col("text").alias("question")), "query_id"), k_final, predict)
    return expand_parents(found, chunks, max_chars) if expand else found.select("query_id", "chunk_id", "text", "rank")


def quick_retrieve(chunks: DataFrame, queries: DataFrame, k: int = 5, each: int = 20) -> DataFrame:
    """The smallest retriever: hashing vectors and BM25 over all rows, 20 of each, fused, the best 5. ``query_id, chunk_id, rrf_score, rank``."""
    top = dense.sparse_topk(embed.hashed(chunks), embed.hashed(queries, "query_id"), each).select("query_id", "chunk_id", "rank")
    return dense.ranked(rrf(top.union(lexical.bm25_topk(chunks, queries, each).select("query_id", "chunk_id", "rank"))), k, "rrf_score", True)


def choose_retriever(store: bool, chunks: DataFrame | None, vectors: DataFrame | None) -> str:
    """``store`` or ``files``. A configured store that cannot be read is an error: nothing falls back to files in silence."""
    if store:
        if chunks is None or vectors is None:
            raise RuntimeError("the configured store cannot be read")
        return "store"
    if chunks is None:
        raise RuntimeError("neither a store nor chunk files are given")
    return "files"


def search_text(chunks: DataFrame, vectors: DataFrame, text: str, k_final: int = 6, want_type: str | None = None, want_source: str | None = None, k_dense: int = 60, k_lexical: int = 60) -> DataFrame:
    """One question asked anew: the SEARCH_HIT columns of its best rows, the score as a float, in order."""
    q = chunks.sparkSession.createDataFrame([(1, text)], "query_id int, text string")
    hits = search_chunks(chunks, vectors, q, embed.hashed(q, "query_id"), k_dense, k_lexical, k_final, source_type=want_type, source_id=want_source)
    return hits.orderBy("final_rank").select(*[F.col(c).cast("float") if c == "rrf_score" else F.col(c) for c in SEARCH_HIT])


_STOP = ", ".join(f"'{w}'" for w in lexical.STOPWORDS)
SEARCH_FUNCTION = f"""
CREATE OR REPLACE TEMPORARY FUNCTION search_hits(q STRING, k_final INT DEFAULT 6, want_type STRING DEFAULT NULL, want_source STRING DEFAULT NULL)
RETURNS TABLE (chunk_id STRING, text STRING, section STRING, source_id STRING, page INT, url STRING, parent_id STRING, chunk_index INT, title STRING, lang STRING, rrf_score FLOAT, dense_rank INT, lexical_rank INT)
RETURN WITH asked AS (SELECT array_distinct(filter(regexp_extract_all(lower(q), '([\\\\p{{L}}\\\\p{{N}}]+)', 1), w -> w NOT IN ({_STOP}))) AS terms, regexp_extract_all(lower(q), '([a-z0-9]+)', 1) AS words),
 weights AS (SELECT bucket, 1 + ln(count(*)) AS raw FROM (SELECT cast(conv(substring(md5(w), 25, 8), 16, 10) AS bigint) & 1023 AS bucket FROM (SELECT explode(words) AS w FROM asked)) GROUP BY bucket),
 own AS (SELECT * FROM {{view}}_chunks c WHERE NOT coalesce(c.is_parent, false) AND (want_type IS NULL OR c.source_type = want_type) AND (want_source IS NULL OR c.source_id = want_source)),
 dense AS (SELECT chunk_id, row_number() OVER (ORDER BY distance, chunk_id) AS rank FROM (SELECT v.chunk_id, round(1 - sum(v.weight * w.raw) / max(n.norm), 9) AS distance FROM {{view}}_vectors v JOIN weights w ON v.bucket = w.bucket CROSS JOIN (SELECT sqrt(sum(raw * raw)) AS norm FROM weights) n GROUP BY v.chunk_id) ORDER BY rank LIMIT {{k}}),
 tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, explode(regexp_extract_all(lower(text), '([\\\\p{{L}}\\\\p{{N}}]+)', 1)) AS term FROM own) WHERE term IN (SELECT explode(terms) FROM asked) GROUP BY chunk_id, term),
 hit AS (SELECT chunk_id, count(*) AS matched, round(sum(1 + ln(tf)), 9) AS score FROM tf GROUP BY chunk_id),
 lex AS (SELECT chunk_id, row_number() OVER (ORDER BY matched DESC, score DESC, chunk_id) AS rank FROM hit WHERE matched = (SELECT size(terms) FROM asked) OR (SELECT count(*) FROM hit WHERE matched = (SELECT size(terms) FROM asked)) < {{k}} ORDER BY rank LIMIT {{k}}),
 fused AS (SELECT chunk_id, min(d) AS dense_rank, min(l) AS lexical_rank FROM (SELECT chunk_id, rank AS d, cast(NULL AS int) AS l FROM dense UNION ALL SELECT chunk_id, cast(NULL AS int), rank FROM lex) GROUP BY chunk_id),
 scored AS (SELECT c.chunk_id, c.text, c.section, c.source_id, c.page, c.url, c.parent_id, c.chunk_index, c.title, c.lang, round(coalesce(1 / (60 + dense_rank), 0) + coalesce(1 / (60 + lexical_rank), 0), 9) AS rrf_score, dense_rank, lexical_rank FROM fused JOIN own c ON c.chunk_id = fused.chunk_id)
 SELECT chunk_id, text, section, source_id, page, url, parent_id, chunk_index, title, lang, cast(rrf_score AS float), dense_rank, lexical_rank FROM (SELECT s.*, row_number() OVER (ORDER BY s.rrf_score DESC, s.chunk_id) AS rn FROM scored s) WHERE rn <= k_final
"""


def register_search_function(chunks: DataFrame, vectors: DataFrame, view: str = "search", k: int = 60) -> None:
    """The SQL table function ``search_hits(q, k_final, want_type, want_source)``: hybrid search of any question over these chunks and sparse
    hashing vectors (``chunk_id, bucket, weight``), all in SQL."""
    chunks.createOrReplaceTempView(f"{view}_chunks")
    vectors.createOrReplaceTempView(f"{view}_vectors")
    chunks.sparkSession.sql(SEARCH_FUNCTION.replace("{view}", view).replace("{k}", str(k)))

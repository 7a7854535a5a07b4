"""Vector top-k. A stated set of queries goes in blocks against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship
from . import best

#: Queries of a block; a block is what one pass over the vectors carries.
BLOCK = 2048


def ranked(scored: DataFrame, k: int, score: str, descending: bool, id_col: str = "chunk_id", query_id: str = "query_id") -> DataFrame:
    """The k best rows of each query with their rank from 1; ties go by id. The limit is pushed below the shuffle."""
    order = F.desc(score) if descending else F.asc(score)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(order, id_col))).where(F.col("rank") <= k)


def _partial(ids: list, matrix: np.ndarray, k: int, types: tuple[pa.DataType, pa.DataType]):
    unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(1)
            width = unit.shape[1]
            ok = np.array(lists.is_valid()) & (np.array(lists.value_lengths().fill_null(0)) == width)
            names = np.array(b.column(0).to_pylist(), dtype=object)[ok]
            if not len(names):
                continue
            v = np.array(lists.filter(pa.array(ok)).flatten(), dtype=np.float64).reshape(-1, width)
            d = 1 - unit @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T
            if best:
                d = np.concatenate([best[0][0], d], axis=1)
                names2 = np.concatenate([best[0][1], np.broadcast_to(names, (len(unit), len(names)))], axis=1)
            else:
                names2 = np.broadcast_to(names, (len(unit), len(names)))
            if d.shape[1] > 2 * k:  # ties at the border stay, the last ranking decides
                edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                keep = int((d <= edge + 1e-12).sum(axis=1).max())
                at = np.argpartition(d, min(keep, d.shape[1] - 1), axis=1)[:, :keep]
                d, names2 = np.take_along_axis(d, at, axis=1), np.take_along_axis(names2, at, axis=1)
            best = [(d, names2)]
        if best:
            d, n = best[0]
            q = np.repeat(np.array(ids, dtype=object), d.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q.tolist(), types[0]), pa.array(n.ravel().tolist(), types[1]), pa.array(d.ravel())], names=["query_id", "chunk_id", "distance"])

    return run


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``query_id, chunk_id, distance, rank`` of the k nearest rows by cosine distance, exactly.

    ``queries`` has ``query_id`` and the vector column. Blocks of queries are multiplied with Arrow batches of vectors; a task
    sends k rows a query (and ties at the border). Rows of another width or without a vector are no candidates.
    """
    ship(vectors.sparkSession)
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {vectors.schema[id_col].dataType.simpleString()}, distance double"
    types = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(vectors.schema[id_col].dataType)
    rows = vectors.select(F.col(id_col).alias("chunk_id"), F.col(vec_col).alias("v"))
    out, ids, held = None, [], []

    def flush():
        nonlocal out, ids, held
        part = rows.mapInArrow(_partial(ids, np.array(held, dtype=np.float64), k, types), kinds)
        out = part if out is None else out.union(part)
        ids, held = [], []

    for r in queries.where(F.col(vec_col).isNotNull()).select("query_id", vec_col).orderBy("query_id").toLocalIterator():
        ids.append(r[0])
        held.append(r[1])
        if len(ids) == block:
            flush()
    if ids:
        flush()
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"{kinds}, rank int")
    return ranked(out, k, "distance", False)


def sparse_topk(vectors: DataFrame, queries: DataFrame, k: int, dim: int = 1024, block: int = 1 << 16) -> DataFrame:
    """The same over hashed vectors ``chunk_id, vector`` and ``query_id, vector`` (lists of bucket and weight, of unit length): a query adds
    up the rows' weights in its own buckets, and a task sends k rows a query. Rows that share no bucket with a query are no candidates.
    Each block of queries is one pass over the vectors."""
    ship(vectors.sparkSession)
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, matched bigint, score double"
    types = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(vectors.schema["chunk_id"].dataType)
    rows, out, ids, held = vectors.select("chunk_id", "vector"), None, [], []

    def flush():
        nonlocal out, ids, held
        asked = best.Asked(ids, [[b for b, _ in v] for v in held], [[w for _, w in v] for v in held])
        part = rows.mapInArrow(best.search(asked, dim, k, best.vector_cells, types, 9, distance=True), kinds)
        out = part if out is None else out.union(part)
        ids, held = [], []

    for r in queries.where(F.size("vector") > 0).select("query_id", "vector").toLocalIterator():
        ids.append(r[0])
        held.append(r[1])
        if len(ids) == block:
            flush()
    if ids:
        flush()
    if out is None:
        return vectors.sparkSession.createDataFrame([], kinds.replace("matched bigint, score", "distance") + ", rank int")
    return ranked(out.select("query_id", "chunk_id", (-F.col("score")).alias("distance")), k, "distance", False)


def after_filter(topk: DataFrame, chunks: DataFrame, source_type: str | None = None, source_id: str | None = None) -> DataFrame:
    """Filters after the top-k was taken: ranks keep their gaps and fewer than k rows may be left."""
    own = chunks.where(~F.coalesce("is_parent", F.lit(False)))
    for name, want in (("source_type", source_type), ("source_id", source_id)):
        if want is not None:
            own = own.where(F.col(name) == want)
    return topk.join(own.select("chunk_id"), "chunk_id", "left_semi")

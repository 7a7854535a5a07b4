"""Packing of sentences, sections and chunks of documents and pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import urls as U
from ..functions import vectors as V
from ..schema import SCHEMA_VERSION, chunk_id
from ..session import ship
from .embed import Embedder

_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("overlap", T.IntegerType())]))


def spans(tokens: list[int], target: int, overlap: int) -> list[tuple[int, int, int]]:
    """Windows over sentence sizes, found on their running total: a window ends before the total passes its own start plus ``target``
    (one sentence at least), and the next begins at the last sentence from which ``overlap`` tokens are repeated, but after the last start."""
    total = np.concatenate([[0], np.cumsum(np.asarray(tokens, dtype=np.int64))])
    until = lambda x: int(np.searchsorted(total, x, side="right")) - 1
    out, at, n = [], 0, len(tokens)
    while n and (not out or out[-1][1] < n):
        end = max(until(total[at] + target), at + 1)
        out.append((at, end, overlap if out else 0))
        at = max(until(total[end] - overlap), at + 1)
    return out


def _packer(target: int, overlap: int):
    @F.pandas_udf(_SPAN)
    def pack(tokens: pd.Series) -> pd.Series:
        return pd.Series([spans([int(x) for x in t], target, overlap) if t is not None else None for t in tokens], dtype=object)

    return pack


def overlap_of(target: int, share: float = 0.15) -> int:
    return max(1, int(target * share))


def windows(sentences: Column, target: int, overlap: int, min_tokens: int = 0) -> Column:
    """Array of ``struct(text, overlap)``. Only sentence sizes go through Arrow; texts stay in the JVM. A last window below
    ``min_tokens`` is appended to the one before, repeated sentences included."""
    cut = _packer(target, overlap)(F.transform(sentences, X.count_tokens))
    w = F.transform(cut, lambda s: F.struct(F.array_join(F.slice(sentences, s["start"] + 1, s["stop"] - s["start"]), " ").alias("text"), s["overlap"].alias("overlap")))
    if min_tokens <= 0:
        return w
    # the windows are bound once; the last two are joined where the last is too small
    short = lambda x: (F.size(x) > 1) & (X.count_tokens(F.element_at(x, -1)["text"]) < min_tokens)
    tail = lambda x: F.struct(F.concat_ws(" ", F.element_at(x, -2)["text"], F.element_at(x, -1)["text"]).alias("text"), F.element_at(x, -2)["overlap"].alias("overlap"))
    joined = lambda x: F.when(short(x), F.concat(F.slice(x, 1, F.size(x) - 2), F.array(tail(x)))).otherwise(x)
    return F.get(F.transform(F.array(w), joined), F.lit(0))


def pack_texts(df: DataFrame, id_col: str, text_col: str = "text", target: int = 400, share: float = 0.15, min_tokens: int = 80) -> DataFrame:
    """``id, window_no, text, overlap_tokens, token_count`` of each text's windows."""
    ship(df.sparkSession)
    s = df.select(id_col, X.sentences(F.col(text_col)).alias("s"))
    w = s.select(id_col, F.posexplode(windows(F.col("s"), target, overlap_of(target, share), min_tokens)).alias("window_no", "w"))
    return w.select(id_col, "window_no", F.col("w.text").alias("text"), F.col("w.overlap").alias("overlap_tokens"), X.count_tokens(F.col("w.text")).alias("token_count"))


def semantic_windows(sentences: DataFrame, target: int, key: list[str]) -> DataFrame:
    """A new window where the cosine of neighbouring sentences falls below the first quartile of its section or the target is passed.

    ``sentences`` has the key, ``pos, sentence, embedding`` (unit length). Output: key, ``window_no, text``.
    """
    w = Window.partitionBy(*key).orderBy("pos")
    s = sentences.withColumn("sim", F.round(V.dot(F.lag("embedding").over(w), F.col("embedding")), 6))  # equal in theory, equal here
    low = s.groupBy(*key).agg(F.percentile("sim", F.lit(0.25)).alias("low"))
    s = s.join(low, key).withColumn("cut", F.coalesce((F.col("sim") < F.col("low")).cast("int"), F.lit(0)))
    s = s.withColumn("part", F.sum("cut").over(w)).withColumn("t", X.count_tokens(F.col("sentence")))
    inner = Window.partitionBy(*key, "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("fill", F.floor(F.coalesce(F.sum("t").over(inner), F.lit(0)) / target))
    s = s.withColumn("window_no", F.dense_rank().over(Window.partitionBy(*key).orderBy("part", "fill")) - 1)
    return s.groupBy(*key, "window_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))


def markdown_blocks(pages: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Markdown pages (key, ``page, text``) into blocks: a heading block for each heading line and a body block for what follows;
    empty bodies go, the heading carried along starts anew on each page."""
    key = [*(key or ["source_id"]), "page"]
    lines = pages.select(*key, F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("level", X.heading_level(F.col("line")))
    w = Window.partitionBy(*key).orderBy("pos")
    lines = lines.withColumn("part", F.sum((F.col("level") > 0).cast("int")).over(w)).withColumn("head", F.when(F.col("level") > 0, X.clean_heading(F.regexp_extract(X.py_strip(F.col("line")), r"^#{1,6}\s+(.*)$", 1))))
    lines = lines.withColumn("heading", F.last("head", ignorenulls=True).over(w)).withColumn("heading_level", F.last(F.when(F.col("level") > 0, F.col("level")), ignorenulls=True).over(w))
    heads = lines.where("level > 0").select(*key, "part", F.lit(0).alias("kind"), F.col("head").alias("text"), "heading", "heading_level", F.lit(True).alias("is_heading"))
    body = lines.where("level = 0").groupBy(*key, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"), F.first("heading").alias("heading"), F.first("heading_level").alias("heading_level"))
    body = body.withColumn("text", X.py_strip(F.col("text"))).where("text <> ''").select(*key, "part", F.lit(1).alias("kind"), "text", "heading", "heading_level", F.lit(False).alias("is_heading"))
    doc = Window.partitionBy(*key[:-1]).orderBy("page", "part", "kind")
    return heads.union(body).withColumn("block_pos", F.row_number().over(doc) - 1).withColumn("block_type", F.lit("text")).select(*key, "block_pos", "text", "heading", "heading_level", "is_heading", "block_type")


def strip_running_lines(pages: DataFrame, key: str = "source_id", max_chars: int = 80, share: float = 0.5, least: int = 2) -> DataFrame:
    """Pages (key, ``page, pos, text``) without short lines that stand on at least ``share`` of the document's pages, two at least."""
    lines = pages.select(key, "page", "pos", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("k", X.line_key(F.col("line")))
    short = lines.where((F.col("k") != "") & (F.length(X.py_strip(F.col("line"))) <= max_chars)).select(key, "page", "k").distinct().groupBy(key, "k").agg(F.count("*").alias("n"))
    total = pages.groupBy(key).agg(F.count_distinct("page").alias("n_pages"))
    running = short.join(total, key).where((F.col("n") >= least) & (F.col("n") >= share * F.col("n_pages"))).select(key, "k")
    kept = lines.join(running, [key, "k"], "left_anti")
    return kept.groupBy(key, "page", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


def sections(blocks: DataFrame) -> DataFrame:
    """Blocks with ``section_no`` (headings so far) and ``section`` (the last heading's text), over the whole document."""
    w = Window.partitionBy("source_id").orderBy("block_pos")
    return blocks.withColumn("section_no", F.sum(F.col("is_heading").cast("int")).over(w)).withColumn("section", F.last(F.when(F.col("is_heading"), F.col("text")), ignorenulls=True).over(w))


def section_sentences(blocks: DataFrame) -> DataFrame:
    """``source_id, section_no, pos, sentence`` of the prose of every section."""
    s = sections(blocks).where("not is_heading and block_type = 'text'").groupBy("source_id", "section_no").agg(F.array_sort(F.collect_list(F.struct("block_pos", "text"))).alias("b"))
    body = X.py_strip(F.array_join(F.transform("b", lambda x: x["text"]), "\n"))
    return s.select("source_id", "section_no", F.posexplode(X.sentences(body)).alias("pos", "sentence"))


def semantic_sections(blocks: DataFrame, embedder: Embedder, target: int = 400) -> DataFrame:
    """``source_id, section_no, window_no, text``: semantic windows of the prose of every section; a sentence that the embedder leaves out has cosine 0."""
    s = section_sentences(blocks).withColumn("sid", F.concat_ws("/", "source_id", "section_no", "pos"))
    v = embedder.transform(s, "sid", "sentence").select("sid", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    if embedder.encode is not None:  # hashing vectors have unit length; the norm is an array's element, so that it is taken once a vector
        v = v.withColumn("embedding", F.zip_with("embedding", F.array_repeat(V.norm(F.col("embedding")) + 1e-8, F.size("embedding")), lambda x, n: x / n))
    s = s.join(v, "sid", "left").withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0), embedder.dim)))
    return semantic_windows(s, target, ["source_id", "section_no"])


def chunk_documents(blocks: DataFrame, docs: DataFrame, strategy: str = "structure", target: int = 400, share: float = 0.15, parent_max: int = 2000, min_tokens: int = 80, embedder: Embedder | None = None) -> DataFrame:
    """Chunks of documents: prose of a section in windows behind its heading, tables and figures alone; with ``parent_child`` a parent
    for each section that has prose; with ``semantic`` and an embedder, windows where neighbouring sentences differ (without one as
    ``structure``). One shuffle by document, and for the embedder's vectors one by sentence.

    ``blocks``: ``source_id, block_pos, text, page, is_heading, block_type``; ``docs``: ``source_id, title, lang, backend, page_count``.
    """
    if strategy not in ("structure", "parent_child", "semantic"):
        raise ValueError(f"unknown chunking strategy {strategy!r}")
    ship(blocks.sparkSession)
    s = sections(blocks).where("not is_heading")
    item = F.struct("block_pos", "text", "page", "block_type")
    g = s.groupBy("source_id", "section_no").agg(F.first("section").alias("section"), F.array_sort(F.collect_list(item)).alias("b"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    prose = F.filter("b", lambda x: x["block_type"] == "text")
    g = g.withColumn("prose", prose).withColumn("special", F.filter("b", lambda x: x["block_type"] != "text")).withColumn("body", X.py_strip(F.array_join(F.transform("prose", lambda x: x["text"]), "\n")))
    g = g.withColumn("s", X.sentences(F.col("body")))
    if strategy == "semantic" and embedder is not None:
        w = semantic_sections(blocks, embedder, target).groupBy("source_id", "section_no").agg(F.array_sort(F.collect_list(F.struct("window_no", "text"))).alias("w"))
        cut = F.transform("w", lambda x, i: F.struct(x["text"].alias("text"), F.when(i > 0, overlap_of(target, share)).otherwise(0).alias("overlap")))
        g = g.join(w, ["source_id", "section_no"], "left").withColumn("win", F.coalesce(cut, F.array().cast("array<struct<text:string,overlap:int>>")))
    else:
        g = g.withColumn("win", windows(F.col("s"), target, overlap_of(target, share), min_tokens))
    # the first block whose opening occurs in the window gives its page
    page_of = lambda w: F.coalesce(F.get(F.filter("prose", lambda x: F.contains(w, F.substring(x["text"], 1, 80))), F.lit(0))["page"], F.col("page_start"))
    empty = lambda t: F.lit(None).cast(t)
    one = lambda rank, parent, text, page, tokens, overlap, kind: F.struct(F.lit(rank).alias("rank") if isinstance(rank, int) else rank.alias("rank"), F.lit(parent).alias("is_parent"), text.alias("text"), page.alias("page"), tokens.alias("token_count"), overlap.cast("int").alias("overlap_tokens"), kind.alias("kind"))
    rows = F.transform("win", lambda w, i: one(i, False, X.with_heading(F.col("section"), w["text"]), page_of(w["text"]), X.count_tokens(X.with_heading(F.col("section"), w["text"])), w["overlap"], empty("string")))
    extra = F.transform("special", lambda x, i: one(i + F.coalesce(F.size("win"), F.lit(0)), False, X.with_heading(F.col("section"), x["text"]), x["page"], X.count_tokens(X.with_heading(F.col("section"), x["text"])), F.lit(0), x["block_type"]))
    top = F.array(one(-1, True, X.truncate_tokens(F.col("body"), parent_max), F.col("page_start"), X.count_tokens(F.col("body")), F.lit(0), empty("string")))
    all_rows = F.concat(F.when((F.col("body") != "") & F.lit(strategy == "parent_child"), top).otherwise(F.slice(top, 1, 0)), F.when(F.col("body") != "", rows).otherwise(F.slice(rows, 1, 0)), extra)
    c = g.select("source_id", "section_no", "section", "page_start", "page_end", F.explode(all_rows).alias("c")).select("source_id", "section_no", "section", "page_start", "page_end", "c.*")
    c = c.withColumn("chunk_index", F.row_number().over(Window.partitionBy("source_id").orderBy("section_no", "rank")) - 1)
    c = c.withColumn("source_type", F.lit("pdf")).withColumn("chunk_id", chunk_id(F.lit("pdf"), F.col("source_id"), F.col("chunk_index"), F.col("is_parent")))
    c = c.withColumn("parent_id", F.when(~F.col("is_parent"), F.max(F.when(F.col("is_parent"), F.col("chunk_id"))).over(Window.partitionBy("source_id", "section_no"))))
    c = c.join(docs, "source_id", "left")
    meta = F.to_json(F.struct("backend", "page_count", "page_start", "page_end", F.col("kind").alias("block_type")))
    return c.select("chunk_id", "text", "source_type", "source_id", "chunk_index", X.real_title(F.col("title")).alias("title"), "section", "page", "lang", "parent_id", "is_parent", "token_count", "overlap_tokens", meta.alias("extra"), F.lit(SCHEMA_VERSION).alias("schema_version"))


def chunk_pages(pages: DataFrame, target: int = 550, share: float = 0.15, min_tokens: int = 80, min_chars: int = 200) -> DataFrame:
    """Chunks of web pages (``url, title, text``); pages of less than ``min_chars`` characters are dropped."""
    ship(pages.sparkSession)
    p = pages.withColumn("text", X.py_strip(F.col("text"))).where(F.length("text") >= min_chars)
    p = p.select("url", "title", X.sentences(F.col("text")).alias("s"))  # a column, so that windows do not split the text anew
    w = p.select("url", "title", F.posexplode(windows(F.col("s"), target, overlap_of(target, share), min_tokens)).alias("chunk_index", "w"))
    return w.select(
        chunk_id(F.lit("web"), F.col("url"), F.col("chunk_index"), F.lit(False)).alias("chunk_id"), F.col("w.text").alias("text"), F.lit("web").alias("source_type"), F.col("url").alias("source_id"), "chunk_index", "title",
        F.col("title").alias("section"), "url", U.site(F.col("url")).alias("domain"), F.lit(None).cast("string").alias("lang"), F.lit(False).alias("is_parent"), X.count_tokens(F.col("w.text")).alias("token_count"),
        F.col("w.overlap").alias("overlap_tokens"), F.lit('{"block_type": "web"}').alias("extra"), F.lit(SCHEMA_VERSION).alias("schema_version"),
    )


def reindexed(chunks: DataFrame) -> DataFrame:
    """Contiguous chunk_index from 0 within a source; ids stay."""
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy("source_id").orderBy("chunk_index", "chunk_id")) - 1)

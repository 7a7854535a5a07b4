"""From files, seeds or questions to stored chunks, sets and answers: the operators put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, dedup, embed, store
from ..schema import CHUNK, conform
from ..session import settle
from ..sources import crawl, files, manifest, pdf


def pdf_chunks(found: DataFrame, extract: Callable | None = None, backend: str = "pymupdf4llm", strategy: str = "parent_child", ocr: Callable | None = None, extras: Callable | None = None, detect: Callable[[str], str | None] | None = None, embedder: embed.Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """``(chunks, failures)`` of PDF files (``source_id, content``): pages, running lines off, blocks, tables and figures, chunks without exact
    copies in a file. A file that fails is named in ``failures`` (``source_id, error``) and the rest goes on."""
    pages = settle(pdf.pages(found, backend, extract), "pdf-pages")
    failures = pages.where("error is not null").select("source_id", "error")
    good = pdf.with_ocr(pages.where("error is null"), found, ocr)
    good = good.withColumn("page", F.coalesce("page", F.lit(1)))
    bare = chunking.strip_running_lines(good.select("source_id", "page", F.lit(0).alias("pos"), "text"))
    blocks = chunking.markdown_blocks(bare.select("source_id", "page", "text"))
    if extras is not None:
        read = good.select("source_id").distinct()
        blocks = pdf.with_extras(blocks, pdf.extras(found.join(read, "source_id", "left_semi"), extras))
    blocks = settle(blocks, "pdf-blocks")
    docs = good.groupBy("source_id").agg(F.max("page").alias("page_count"), F.min_by("text", "page").alias("text"))
    title = blocks.where("is_heading").groupBy("source_id").agg(F.min_by("text", "block_pos").alias("title"))
    docs = docs.join(title, "source_id", "left").withColumn("lang", F.lit(None).cast("string")).withColumn("backend", F.lit(backend))
    docs = pdf.with_language(docs, detect).select("source_id", "title", "lang", "backend", "page_count")
    chunks = dedup.keep_first(chunking.chunk_documents(blocks, docs, strategy, embedder=embedder), ["chunk_index", "chunk_id"], ["source_id"])
    return conform(chunks.withColumn("created_at", F.current_timestamp())), failures


def pdf_folder(spark: SparkSession, root: str, done: DataFrame | None = None, **kw) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(chunks, failures, manifest)`` of the new and changed PDF files below a folder; only successes enter the manifest."""
    found = pdf.scan(spark, root)
    seen = found.select("path", F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"), "source_id")
    known = done if done is not None else spark.createDataFrame([], "path string, mtime bigint, size bigint")
    fresh = settle(manifest.changed(seen, known), "pdf-new")
    chunks, failures = pdf_chunks(found.join(fresh.select("path"), "path", "left_semi"), **kw)
    bad = fresh.join(failures.select("source_id").distinct(), "source_id", "left_semi").select("path")
    return chunks, failures, manifest.mark(known, fresh.select("path", "mtime", "size"), bad)


def web_chunks(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], bodies: DataFrame, near: bool = True, main_text: Callable[[str], str | None] | None = None, **kw) -> tuple[DataFrame, DataFrame]:
    """``(chunks, pdfs)`` of a crawl: reached pages (``bodies``: ``url, html``) to text and title, chunks without exact and near copies, indexes
    counted anew; and the PDFs it met (``url, filename``)."""
    reached = settle(crawl.crawl(seeds, fetch, **kw), "crawled")
    pages = reached.where("kind = 'page'").select("url").distinct().join(bodies.select("url", "html"), "url")
    texts = pages.select("url", X.html_title(F.col("html")).alias("title"), X.html_text(F.col("html"), main_text).alias("text"))
    chunks = settle(chunking.chunk_pages(texts), "web-chunks")
    order = ["source_id", "chunk_index", "chunk_id"]
    one = dedup.near_dedup(chunks, order=order) if near else dedup.keep_first(chunks, order)
    return conform(chunking.reindexed(one).withColumn("created_at", F.current_timestamp())), crawl.pdf_links(reached.where("kind = 'pdf'"))


def ingest(chunks: DataFrame, vectors: DataFrame, fresh: DataFrame, embedder: embed.Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """The store after these chunks: their sources anew, and vectors for all children that have none."""
    from ..streaming.worker import embed_missing

    c, v = store.reingest(chunks, vectors, fresh)
    c = settle(conform(c, CHUNK), "ingested")
    e = embedder or embed.Embedder()
    return c, v.unionByName(embed_missing(c, v, e.backend, e.dim, e.encode))


def split_by_kind(chunks: DataFrame, path: str) -> None:
    files.write_kinds(chunks, path)

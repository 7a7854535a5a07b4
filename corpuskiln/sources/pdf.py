"""PDF files through plug-in extractors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .files import relative_id

#: Backend name -> function of the file's bytes, giving rows (page, text) of markdown or plain text.
BACKENDS: dict[str, Callable[[bytes], list[tuple[int | None, str]]]] = {}
FALLBACK = "pymupdf"


def register(name: str, extract: Callable[[bytes], list[tuple[int | None, str]]]) -> None:
    BACKENDS[name] = extract


def backend(name: str) -> Callable[[bytes], list[tuple[int | None, str]]]:
    """The backend, or the fallback where its library is missing; an unknown name is an error."""
    known = {"pymupdf4llm", "docling", "pymupdf", *BACKENDS}
    if name not in known:
        raise ValueError(f"unknown PDF backend {name!r}")
    for n in (name, FALLBACK):
        if n in BACKENDS:
            return BACKENDS[n]
        try:
            return _library(n)
        except ImportError:
            continue
    raise RuntimeError("no PDF library is installed; register a backend")


def _library(name: str):
    if name == "pymupdf4llm":
        import pymupdf
        import pymupdf4llm

        return lambda data: [(p["metadata"]["page"], p["text"]) for p in pymupdf4llm.to_markdown(pymupdf.open(stream=data), page_chunks=True)]
    if name == "docling":
        from io import BytesIO

        from docling.datamodel.base_models import DocumentStream
        from docling.document_converter import DocumentConverter

        return lambda data: [(None, DocumentConverter().convert(DocumentStream(name="x.pdf", stream=BytesIO(data))).document.export_to_markdown())]
    import pymupdf

    return lambda data: [(k + 1, p.get_text()) for k, p in enumerate(pymupdf.open(stream=data))]


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``source_id, path, sha256, content`` of every PDF below the root."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(root)
    return f.select(relative_id(F.col("path"), root).alias("source_id"), "path", F.sha2("content", 256).alias("sha256"), "content", "modificationTime", "length")


def pages(files: DataFrame, name: str = "pymupdf4llm", extract: Callable | None = None) -> DataFrame:
    """``source_id, page, text, error``: a row for each page; a file that fails has one row with its error and the run goes on."""
    fn = extract or backend(name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for sid, data in zip(b["source_id"], b["content"]):
                try:
                    rows += [(sid, p, t, None) for p, t in fn(bytes(data))]
                except Exception as e:  # noqa: BLE001
                    rows.append((sid, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame({"source_id": [r[0] for r in rows], "page": pd.array([r[1] for r in rows], dtype="Int32"), "text": [r[2] for r in rows], "error": [r[3] for r in rows]})

    return files.select("source_id", "content").mapInPandas(run, "source_id string, page int, text string, error string")


read_pages = pages


def scanned_share(pages: DataFrame, least: int = 40) -> DataFrame:
    """``source_id, scanned_share, needs_ocr, page_count``: pages with fewer than ``least`` characters."""
    thin = (F.length(F.trim(F.coalesce("text", F.lit("")))) < least).cast("int")
    return pages.groupBy("source_id").agg(F.round(F.avg(thin), 6).alias("scanned_share"), (F.avg(thin) > 0).alias("needs_ocr"), F.max("page").alias("page_count"))


def with_extras(blocks: DataFrame, extras: DataFrame, legacy_order: bool = False) -> DataFrame:
    """Tables and figures put behind the blocks of their page and heading; with ``legacy_order`` behind all blocks. Tables of fewer than
    two filled rows and unreadable figure texts are left out."""
    good = extras.where(F.when(F.col("block_type") == "table", F.size(X.table_rows(F.col("text"))) >= 2).otherwise(X.keep_figure_text(F.col("text"))))
    both = blocks.withColumn("__late", F.lit(0)).unionByName(good.withColumn("__late", F.lit(1)).withColumn("is_heading", F.lit(False)), allowMissingColumns=True)
    from pyspark.sql import Window

    place = ["__late", "block_pos"] if legacy_order else ["page", "__late", "block_pos"]
    return both.withColumn("block_pos", F.row_number().over(Window.partitionBy("source_id").orderBy(*place)) - 1).drop("__late")


def with_ocr(pages: DataFrame, files: DataFrame, ocr: Callable[[bytes], list[tuple[int | None, str]]] | None, least: int = 40) -> DataFrame:
    """Pages (``source_id, page, text, error``) of documents that have thin pages, read anew by the OCR hook from their file; without a hook, or
    where it fails, the pages stay as they are."""
    if ocr is None:
        return pages
    need = scanned_share(pages, least).where("needs_ocr").select("source_id")
    good = read_pages(files.join(need, "source_id", "left_semi"), extract=ocr).where("error is null")
    return pages.join(good.select("source_id").distinct(), "source_id", "left_anti").unionByName(good)


def extras(files: DataFrame, extract: Callable[[bytes], list[tuple[int | None, str, object]]]) -> DataFrame:
    """Tables and figures of every file by a hook that gives (page, kind, content): a table's rows of cells, or a figure's text. As blocks
    ``source_id, page, block_type, text``; tables become markdown. A file that fails has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for sid, data in zip(b["source_id"], b["content"]):
                try:
                    rows += [(sid, p, kind, x if kind != "table" else None, [[None if c is None else str(c) for c in r] for r in x] if kind == "table" else None) for p, kind, x in extract(bytes(data))]
                except Exception:  # noqa: BLE001
                    continue
            yield pd.DataFrame({"source_id": [r[0] for r in rows], "page": pd.array([r[1] for r in rows], dtype="Int32"), "block_type": [r[2] for r in rows], "said": [r[3] for r in rows], "cells": [r[4] for r in rows]})

    raw = files.select("source_id", "content").mapInPandas(run, "source_id string, page int, block_type string, said string, cells array<array<string>>")
    return raw.select("source_id", "page", "block_type", F.when(F.col("block_type") == "table", X.markdown_table(F.col("cells"))).otherwise(F.col("said")).alias("text"))


def with_language(docs: DataFrame, detect: Callable[[str], str | None] | None, text_col: str = "text") -> DataFrame:
    """Documents with ``lang`` filled by a hook where it is null; a failure leaves it null."""
    if detect is None:
        return docs

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return detect(t) if t else None
            except Exception:  # noqa: BLE001
                return None

        return pd.Series([one(t) for t in texts], dtype=object)

    return docs.withColumn("lang", F.coalesce("lang", run(F.when(F.col("lang").isNull(), F.col(text_col)))))

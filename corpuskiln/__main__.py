"""Command line: ``python -m corpuskiln COMMAND``. Each command is one operator or pipeline over files."""

from __future__ import annotations

import argparse


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpuskiln", description="Text corpora and hybrid retrieval on Spark")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, help_: str, *positional: str, **options):
        c = sub.add_parser(name, help=help_)
        for a in positional:
            c.add_argument(a)
        for k, v in options.items():
            c.add_argument("--" + k.replace("_", "-"), **v)

    add("pdf", "chunks of a folder of PDFs", "folder", "out", backend={"default": "pymupdf4llm"}, strategy={"default": "parent_child"})
    add("ask", "one question over a folder of PDFs", "folder", "question", backend={"default": "pymupdf4llm"}, k={"type": int, "default": 3})
    add("combine", "one table of chunk files", "out", files={"nargs": "+", "required": True})
    add("embed", "vectors of the chunks that have none", "chunks", "out", vectors={"default": None})
    add("search", "one question over chunks", "chunks", "question", k={"type": int, "default": 6}, type={"default": None}, source={"default": None})
    add("sets", "instruction rows for training and validation", "chunks", "out", share={"type": float, "default": 0.1})
    add("golden", "labelled questions", "chunks", "out", n={"type": int, "default": 25})
    add("report", "chunks by source", "chunks")
    add("query", "a registered query over a folder of tables", "name", "folder", "out")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    from .operators import dataset, embed, golden, search, store
    from .session import local_session, scope
    from .sources import files
    from .streaming.worker import embed_missing

    spark = spark or local_session()
    with scope(spark):
        if a.command == "pdf":
            from .plans.pipelines import pdf_folder

            chunks, failures, _ = pdf_folder(spark, a.folder, backend=a.backend, strategy=a.strategy)
            files.write_jsonl(chunks, a.out)
            bad = failures.count()
            print(f"{bad} files failed")
            return 1 if bad else 0
        if a.command == "ask":
            from .operators import faithfulness
            from .plans.pipelines import pdf_folder
            from .session import settle

            chunks = settle(pdf_folder(spark, a.folder, backend=a.backend)[0], "asked")
            found = lambda k: search.search_text(chunks, embed.hashed(chunks), a.question, k or a.k).collect()
            print(faithfulness.gated_answer(found, faithfulness.extractive, lambda answer, hits: False, a.k)[0])
            return 0
        if a.command == "combine":
            files.write_parquet(files.combine(spark, a.files, lambda p: print(f"missing: {p}")), a.out)
        elif a.command == "embed":
            c = files.read_any(spark, a.chunks)
            v = spark.read.parquet(a.vectors) if a.vectors else spark.createDataFrame([], "chunk_id string")
            files.write_parquet(embed_missing(c, v), a.out)
        elif a.command == "search":
            c = files.read_any(spark, a.chunks)
            search.search_text(c, embed.hashed(c), a.question, a.k, a.type, a.source).show(truncate=80)
        elif a.command == "sets":
            print(dataset.write_sets(files.read_any(spark, a.chunks), a.out, a.share))
        elif a.command == "golden":
            files.write_jsonl(golden.build(files.read_any(spark, a.chunks), a.n), a.out)
        elif a.command == "report":
            c = files.read_any(spark, a.chunks)
            store.source_report(c, spark.createDataFrame([], "chunk_id string")).orderBy("source_type", "source_id").show(1000, truncate=False)
        else:
            from .plans.catalog import QUERIES

            if a.name not in QUERIES:
                print(f"unknown query {a.name!r}")
                return 2
            QUERIES[a.name](spark, a.folder).write.parquet(a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

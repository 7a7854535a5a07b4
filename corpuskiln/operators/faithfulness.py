"""Is an answer borne out by the passages it was given?"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# What marks an extract, and what is said where nothing was found; other parts of a system look for them.
EXTRACTIVE, NO_CONTEXT = "[extractive]", "No relevant context found."
REFUSAL = "The passages found do not bear out this answer."


def check(answers: DataFrame, hits: DataFrame, min_overlap: float = 0.4, min_words: int = 6) -> DataFrame:
    """``answer_id, ok, n_checked, n_unsupported, cited``: each sentence of enough words is held against the hit that shares the largest part
    of its content words (ties: the first hit). An answer with no checked sentence is not ok; extractive answers pass.

    ``answers`` has ``answer_id, answer``; ``hits`` has ``answer_id, chunk_id, text, hit_no``.
    """
    a = answers.withColumn("pass", F.startswith(X.py_strip(F.col("answer")), F.lit(EXTRACTIVE)) | (X.py_strip(F.col("answer")) == NO_CONTEXT))
    s = a.where("not pass").select("answer_id", F.posexplode(X.sentences(X.py_strip(F.col("answer")))).alias("pos", "sentence"))
    s = s.withColumn("n_words", F.size(F.regexp_extract_all(X.casefold(F.col("sentence")), F.lit("([a-z0-9]+)"), 1))).withColumn("w", X.content_words(F.col("sentence"))).where((F.col("n_words") >= min_words) & (F.size("w") > 0))
    h = hits.select("answer_id", "chunk_id", "hit_no", X.content_words(F.col("text")).alias("hw"))
    pair = s.select("answer_id", "pos", "w").join(h, "answer_id", "left").withColumn("share", F.coalesce(F.size(F.array_intersect("w", "hw")) / F.size("w"), F.lit(0.0)))
    best = pair.groupBy("answer_id", "pos").agg(F.max(F.struct("share", (-F.col("hit_no")).alias("o"), "chunk_id")).alias("b"))
    per = best.groupBy("answer_id").agg(
        F.count("*").alias("n_checked"),
        F.count_if(F.col("b.share") < min_overlap).alias("n_unsupported"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("b.share") >= min_overlap, F.struct("pos", F.col("b.chunk_id").alias("c"))))), lambda x: x["c"])).alias("cited"),
    )
    j = a.join(per, "answer_id", "left")
    n, bad = F.coalesce("n_checked", F.lit(0)), F.coalesce("n_unsupported", F.lit(0))
    return j.select("answer_id", (F.col("pass") | ((n > 0) & (bad == 0))).alias("ok"), n.alias("n_checked"), bad.alias("n_unsupported"), F.coalesce("cited", F.array().cast("array<string>")).alias("cited"))


def refusal(unsupported, sources):
    """Text in place of an answer that is not borne out."""
    return F.concat_ws("\n", F.lit(REFUSAL), F.concat(F.lit("Not supported: "), F.array_join(unsupported, " | ")), F.concat(F.lit("Looked at: "), F.array_join(sources, ", ")))


def gated_answer(search: Callable[[int | None], list], generate: Callable[[list], str], judge: Callable[[str, list], bool], k: int, retries: int = 1, refuse: Callable[[str, list], str] | None = None) -> tuple[str, list]:
    """``(answer, hits)``: an answer that holds, or what is said in its place.

    Without hits nothing is generated. While an answer does not hold, it is asked again with k * (attempt + 1) passages; a wider search
    without hits ends that. Extractive answers pass. An answer that holds at no attempt is replaced by the refusal's text.
    """
    hits = search(None)
    if not hits:
        return NO_CONTEXT, hits
    answer = generate(hits)
    for attempt in range(1, retries + 2):
        if passes(answer) or judge(answer, hits):
            return answer, hits
        wider = search(k * (attempt + 1)) if attempt <= retries else None
        if not wider:
            break
        hits = wider
        answer = generate(hits)
    return (refuse(answer, hits) if refuse else REFUSAL), hits


def extractive(hits: list) -> str:
    """The answer without a model: the passages themselves, with where they stand. ``hits`` have ``text, source_id, page``."""
    lines = [f"{h['text']} ({h['source_id']}" + (f", p. {h['page']})" if h["page"] is not None else ")") for h in hits]
    return "\n\n".join([EXTRACTIVE, *lines]) if lines else NO_CONTEXT


def passes(answer: str | None) -> bool:
    """Answers that are not checked: extracts, and that nothing was found."""
    a = (answer or "").strip()
    return a.startswith(EXTRACTIVE) or a == NO_CONTEXT


def prompt(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, prompt``: numbered passages with their citation, then the question. ``hits``: ``query_id, rank, text, title, section, page, url``."""
    cite = F.concat_ws(", ", "title", "section", F.concat(F.lit("p. "), F.col("page").cast("string")), "url")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("text"), F.lit(" ("), cite, F.lit(")"))
    w = hits.select("query_id", "rank", line.alias("line"))
    body = w.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n").alias("context"))
    return queries.join(body, "query_id").select("query_id", F.concat(F.lit("Context:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("text"), F.lit("\nAnswer:")).alias("prompt"))



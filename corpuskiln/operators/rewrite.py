"""Query rewriting: no change, or term groups of a lexicon."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold_diacritics
from ..session import broadcast_if_small


def lexicon(spark: SparkSession, groups: list[list[str]]) -> DataFrame:
    """Groups of spellings, in declared order, as ``term, alts``: alts are the group's other spellings of a term."""
    rows = []
    for g in groups:
        for v in dict.fromkeys(x.lower() for x in g):
            rows.append((v, [x for x in g if x.lower() != v]))
    return spark.createDataFrame(list(dict((r[0], r) for r in rows).values()), "term string, alts array<string>")


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        return lexicon(spark, [g["variants"] for g in json.load(f)["groups"]])


def small_terms(terms: DataFrame) -> DataFrame:
    """The lexicon, broadcast if it is counted small."""
    return broadcast_if_small(terms, 400)


def noop(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.lit(0).alias("variant_no"), "text")


def expand(queries: DataFrame, terms: DataFrame, steps: int = 3) -> DataFrame:
    """``query_id, variant_no, text``: the query as 0, then for each step the query with every known term replaced by its next
    other spelling, in declared order; equal wordings once."""
    parts = queries.select("query_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+)"), 1)).alias("pos", "tok"))
    hit = parts.withColumn("term", F.lower("tok")).join(small_terms(terms), "term", "left")
    step = hit.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    alt = F.get("alts", F.col("s"))
    made = step.groupBy("query_id", "s").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(alt, F.col("tok")).alias("t")))), lambda x: x["t"]), "").alias("text"),
        F.max(alt.isNotNull()).alias("changed"),
    )
    every = noop(queries).union(made.where("changed").select("query_id", F.col("s") + 1, "text"))
    first = every.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "text").orderBy("variant_no"))).where("r = 1")
    return first.select("query_id", (F.row_number().over(Window.partitionBy("query_id").orderBy("variant_no")) - 1).alias("variant_no"), "text")


#: Rewriters by name; an unknown name changes nothing.
REWRITERS: dict[str, Callable] = {"noop": lambda q, terms=None, **kw: noop(q), "lexicon": lambda q, terms=None, **kw: expand(q, terms, **kw)}


def register(name: str, rewriter: Callable) -> None:
    """A rewriter of one's own: a function of (queries, terms=..., **kw) giving ``query_id, variant_no, text`` with the query itself as 0."""
    REWRITERS[name] = rewriter


def model_rewriter(wordings: Callable[[str], list[str]]) -> Callable:
    """A rewriter from a function of a question giving other wordings, run on Arrow batches; wordings that repeat or fail are left out."""

    @F.pandas_udf("array<string>")
    def ask(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return [w for w in dict.fromkeys(wordings(t)) if w and w != t]
            except Exception:  # noqa: BLE001
                return []

        return pd.Series([one(t) for t in texts], dtype=object)

    return lambda q, terms=None, **kw: noop(q).union(q.select("query_id", F.posexplode(ask("text")).alias("k", "text")).select("query_id", F.col("k") + 1, "text"))


def rewrite(queries: DataFrame, name: str = "noop", terms: DataFrame | None = None, **kw) -> DataFrame:
    return REWRITERS.get(name, REWRITERS["noop"])(queries, terms=terms, **kw)


def alternative(words: DataFrame, terms: DataFrame) -> DataFrame:
    """``word, alt``: another spelling of each known word, the shortest ASCII one first, else the first."""
    t = small_terms(terms)
    ascii_ = F.filter("alts", lambda a: a.rlike(r"^[\x00-\x7f]+$"))
    shortest = F.element_at(F.array_sort(F.transform(ascii_, lambda a: F.struct(F.length(a).alias("n"), a.alias("a")))), 1)["a"]
    return words.join(t, F.lower("word") == F.col("term")).select("word", F.when(F.size(ascii_) > 0, shortest).otherwise(F.get("alts", F.lit(0))).alias("alt"))


def respelled(texts: DataFrame, terms: DataFrame, id_col: str = "query_id", text_col: str = "text", prefer_ascii: bool = True) -> DataFrame:
    """``id, text`` with every known word in another spelling: of the plain ones (equal to their folded form) the shortest, else the first in declared order."""
    parts = texts.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(text_col, F.lit(r"([\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+)"), 1)).alias("pos", "tok"))
    plain = terms.select("term", F.posexplode("alts").alias("k", "alt")).withColumn("folded", F.lower("alt") == fold_diacritics(F.col("alt")))
    # the order of choice of a term's other spellings, in one struct that the smallest of is taken
    order = F.struct(F.when(F.col("folded") & F.lit(prefer_ascii), 0).otherwise(1).alias("a"), F.when(F.col("folded") & F.lit(prefer_ascii), F.length("alt")).otherwise(F.col("k")).alias("b"), F.col("k").alias("c"), "alt")
    best = plain.groupBy("term").agg(F.min(order)["alt"].alias("alt"))
    hit = parts.withColumn("term", F.lower("tok")).join(small_terms(best), "term", "left")
    item = F.struct("pos", F.coalesce("alt", "tok").alias("t"))
    return hit.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "").alias("text")).withColumnRenamed("id", id_col)

"""Making of labelled questions: document frequencies, distinctive terms, samples, leak guard."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import broadcast_if_small, exists, settle
from .lexical import STOPWORDS

# Words that mark procedures and negations.
PROCEDURAL = r"(?i)\b(first|then|next|afterwards|finally|step\s*[0-9]|procedure|calculate|compute|deduct|subtract|divide|multiply)\b"
NEGATION = r"(?i)\b(not|never|unless|except|without|cannot|avoid|devoid|neither|nor)\b"
STRATA = ["lookup", "procedural", "numeric", "synthesis", "negation", "transliteration", "conflict"]


def block_type(extra: Column) -> Column:
    """The kind of a chunk from its JSON; ``text`` where there is none or it is broken."""
    return F.coalesce(F.get_json_object(extra, "$.block_type"), F.lit("text"))


def doc_freq(chunks: DataFrame) -> DataFrame:
    """``term, df``: chunks that hold each word of three letters or more."""
    return chunks.select(F.explode(F.array_distinct(X.unicode_words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def stored_doc_freq(chunks: DataFrame, path: str) -> DataFrame:
    """The document frequencies written at ``path``; where nothing is there yet they are counted and written first."""
    spark = chunks.sparkSession
    if not exists(spark, path):
        doc_freq(chunks).write.parquet(path)
    return spark.read.schema("term string, df bigint").parquet(path)


def distinctive_terms(chunks: DataFrame, df: DataFrame, n_docs: int, terms: DataFrame | None = None, min_df: int = 5, max_df: float = 0.25, max_terms: int = 4, max_domain: int = 1) -> DataFrame:
    """``chunk_id, pos, term, score`` of each chunk's best words by tf * ln(N / df): words of four letters or more in a band of document
    frequency, standing twice, in the heading, or in the lexicon ``terms`` (of which ``max_domain`` come first). ``chunks``: ``chunk_id, text, section``."""
    tf = chunks.select("chunk_id", F.explode(X.unicode_words(F.col("text"), 4)).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    heads = chunks.select("chunk_id", F.explode(F.array_distinct(X.unicode_words(F.coalesce("section", F.lit(""))))).alias("term")).withColumn("head", F.lit(True))
    band = df.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs) & ~F.col("term").isin(STOPWORDS))
    s = tf.join(band, "term").join(heads, ["chunk_id", "term"], "left")
    domain = F.lit(False)
    if terms is not None:
        s = s.join(broadcast_if_small(terms.select("term", F.lit(True).alias("domain")), 60), "term", "left")
        domain = F.coalesce("domain", F.lit(False))
    s = s.withColumn("is_domain", domain).where((F.col("tf") >= 2) | F.coalesce("head", F.lit(False)) | F.col("is_domain")).withColumn("score", F.round(F.col("tf") * F.log(F.lit(float(n_docs)) / F.col("df")), 6))
    w = Window.partitionBy("chunk_id", "is_domain").orderBy(F.desc("score"), "term")
    s = s.withColumn("r", F.row_number().over(w)).where(~F.col("is_domain") | (F.col("r") <= max_domain))
    best = s.withColumn("pos", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("is_domain"), F.desc("score"), "term")))
    return best.where(F.col("pos") <= max_terms).select("chunk_id", "pos", "term", "score")


def strata_of(text: Column, kind: Column) -> Column:
    """The strata a chunk can bear a question of."""
    prose = kind == "text"
    mark = lambda name, ok: F.when(ok, F.lit(name))
    own = [mark("numeric", kind == "table"), mark("procedural", prose & text.rlike(PROCEDURAL)), mark("negation", prose & text.rlike(NEGATION)), *(mark(s, prose) for s in STRATA if s not in ("numeric", "procedural", "negation"))]
    return F.array_compact(F.array(*own))


def samples(chunks: DataFrame, n: int, strata: list[str] | None = None, min_chars: int = 400) -> DataFrame:
    """``stratum, chunk_id, text, section, source_id, kind``: n chunks for each stratum in the order of a hash of their id, all from one scan; the same on every run."""
    c = chunks.where(~F.coalesce("is_parent", F.lit(False)) & (F.length("text") > min_chars)).withColumn("kind", block_type(F.col("extra")))
    c = c.select(F.explode(strata_of(F.col("text"), F.col("kind"))).alias("stratum"), "chunk_id", "text", "section", "source_id", "kind")
    if strata is not None:
        c = c.where(F.col("stratum").isin(strata))
    salt = F.when(F.col("stratum").isin("numeric", "procedural", "negation"), "").otherwise(F.col("stratum"))
    order = Window.partitionBy("stratum").orderBy(F.md5(F.concat("chunk_id", salt)), "chunk_id")
    # only ids are ranked; the limit is pushed below the shuffle
    best = c.select("stratum", "chunk_id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).select("stratum", "chunk_id")
    return c.join(broadcast_if_small(settle(best, "strata"), 100), ["stratum", "chunk_id"])


def sample(chunks: DataFrame, stratum: str, n: int, min_chars: int = 400) -> DataFrame:
    """The same for one stratum."""
    return samples(chunks, n, [stratum], min_chars).drop("stratum")


# The questions of the offline generator.
TEMPLATES = {
    "lookup": "What do the texts say about {terms}?",
    "synthesis": "How do different sources treat {terms}?",
    "numeric": "Which values are tabulated for {terms}?",
    "procedural": "What is the sequence of steps for {terms}?",
    "negation": "When does {terms} not apply?",
    "conflict": "Where do the sources disagree about {terms}?",
    "transliteration": "What is the significance of {terms}?",
}


def offline_questions(candidates: DataFrame, kids: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """A generator without a model: ``stratum, chunk_id, question, answer`` from each candidate's distinctive terms, two at least; in the
    stratum of spellings from their respelled forms, if any term has another."""
    df, n = doc_freq(kids), kids.count()
    terms = distinctive_terms(candidates.select("chunk_id", "text", "section").dropDuplicates(["chunk_id"]), df, n, lexicon)
    if lexicon is not None:
        from .rewrite import respelled

        alt = respelled(terms.select("term").distinct().withColumn("query_id", F.col("term")), lexicon, "query_id", "term").select(F.col("query_id").alias("term"), F.col("text").alias("alt"))
        terms = terms.join(alt, "term", "left")
    else:
        terms = terms.withColumn("alt", F.col("term"))
    own = terms.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term", F.coalesce("alt", "term").alias("alt")))).alias("t")).where(F.size("t") >= 2)
    q = candidates.join(own, "chunk_id")
    spelled = F.col("stratum") == "transliteration"
    native, other = F.transform("t", lambda x: x["term"]), F.transform("t", lambda x: x["alt"])
    q = q.where(~spelled | (native != other)).withColumn("phrase", F.array_join(F.array_distinct(F.when(spelled, other).otherwise(native)), ", "))
    form = F.create_map(*[F.lit(x) for kv in TEMPLATES.items() for x in kv])
    return q.select("stratum", "chunk_id", F.replace(form[F.col("stratum")], F.lit("{terms}"), F.col("phrase")).alias("question"), X.condense(F.col("text")).alias("answer"))


#: Question generators by name: functions of (candidates, all children, lexicon) giving ``stratum, chunk_id, question, answer``.
GENERATORS: dict[str, Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame]] = {"offline": offline_questions}


def model_questions(ask: Callable[[str, str], tuple[str, str] | None]) -> Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame]:
    """A generator from a function of (stratum, text) giving a question and an answer, or nothing; failures are left out."""

    @F.pandas_udf("struct<question:string,answer:string>")
    def run(strata: pd.Series, texts: pd.Series) -> pd.DataFrame:
        def one(s, t):
            try:
                return ask(s, t) or (None, None)
            except Exception:  # noqa: BLE001
                return None, None

        return pd.DataFrame([one(s, t) for s, t in zip(strata, texts)], columns=["question", "answer"])

    return lambda c, kids, lexicon=None: c.withColumn("qa", run("stratum", "text")).where("qa.question is not null").select("stratum", "chunk_id", "qa.question", "qa.answer")


def build(chunks: DataFrame, n: int, generator: str | Callable = "offline", lexicon: DataFrame | None = None, oversample: int = 6, strata: list[str] | None = None) -> DataFrame:
    """A labelled set: ``question_id, question, answer, stratum, relevant_chunk_ids, source_ids, block_type``, up to n rows a stratum.

    ``oversample`` times as many candidates are drawn, as some bear no question or leak their text; questions of the strata about
    several sources get the partner chunk of another source as well, and go without one. Questions sharing five words in a row with
    their chunk are dropped. The id is a hash of stratum and chunk, so a second run gives the same set.
    """
    kids = chunks.where(~F.coalesce("is_parent", F.lit(False)))
    cand = settle(samples(chunks, n * oversample, strata), "golden-candidates")
    make = GENERATORS[generator] if isinstance(generator, str) else generator
    qa = settle(make(cand, kids, lexicon), "golden-questions")
    qa = qa.join(cand.select("stratum", "chunk_id", "source_id", "kind"), ["stratum", "chunk_id"])
    # two-source questions: candidates of different sources in hash order stand side by side
    several = F.col("stratum").isin("synthesis", "conflict")
    near = Window.partitionBy("stratum").orderBy(F.md5("chunk_id"), "chunk_id")
    two = qa.where(several).withColumn("other", F.lead("chunk_id").over(near)).withColumn("other_source", F.lead("source_id").over(near)).where("other is not null and not (other_source <=> source_id)")
    one = qa.where(~several).withColumn("other", F.lit(None).cast("string")).withColumn("other_source", F.lit(None).cast("string"))
    both = one.unionByName(two).withColumn("question_id", F.xxhash64("stratum", "chunk_id"))
    rows = both.select("question_id", "question", "answer", "stratum", F.array_compact(F.array("chunk_id", "other")).alias("relevant_chunk_ids"), F.array_compact(F.array("source_id", "other_source")).alias("source_ids"), F.col("kind").alias("block_type"), F.md5("chunk_id").alias("__h"))
    rows = settle(rows, "golden-rows")
    leaking = leaks(rows.select(F.col("question_id").alias("query_id"), F.col("question").alias("text"), "relevant_chunk_ids"), chunks)
    clean = rows.join(leaking.select(F.col("query_id").alias("question_id")), "question_id", "left_anti")
    return clean.withColumn("r", F.row_number().over(Window.partitionBy("stratum").orderBy("__h", "question_id"))).where(F.col("r") <= n).drop("r", "__h")


def source_pairs(chunks: DataFrame, salt: str = "synthesis") -> DataFrame:
    """``chunk_a, chunk_b`` from two sources each: sources in hash order, the first with the second, the third with the fourth and so on,
    each by its first chunk. One row a source is ranked, by hash range and then within it, never in one task."""
    first = chunks.where("source_id is not null").groupBy("source_id").agg(F.min(F.struct(F.md5(F.concat("chunk_id", F.lit(salt))).alias("h"), "chunk_id")).alias("f"))
    s = first.select("source_id", F.col("f.chunk_id").alias("chunk_id"), F.md5(F.concat("source_id", F.lit(salt))).alias("o"))
    s = s.withColumn("part", F.substring("o", 1, 2))
    before = s.groupBy("part").agg(F.count("*").alias("k")).withColumn("before", F.sum("k").over(Window.orderBy("part")) - F.col("k")).select("part", "before")
    s = s.join(F.broadcast(before), "part").withColumn("rn", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("o", "source_id")))
    a = s.where("rn % 2 = 1").select("rn", F.col("chunk_id").alias("chunk_a"))
    b = s.where("rn % 2 = 0").select((F.col("rn") - 1).alias("rn"), F.col("chunk_id").alias("chunk_b"))
    return a.join(b, "rn").select("chunk_a", "chunk_b")


def leaks(questions: DataFrame, chunks: DataFrame, n: int = 5) -> DataFrame:
    """``query_id, n_shared``: questions that share a run of n words with their own source chunks. ``questions``: ``query_id, text, relevant_chunk_ids``."""
    # a run of words is in a text if it is in its words joined by single blanks, so the text's own runs are never formed
    q = questions.select("query_id", "relevant_chunk_ids", F.explode(X.ngrams(X.blank_words(F.col("text")), n)).alias("g")).select("query_id", "g", F.explode("relevant_chunk_ids").alias("chunk_id"))
    q = settle(q, "question-runs")
    flat = chunks.join(broadcast_if_small(q.select("chunk_id").distinct(), 60), "chunk_id", "left_semi").select("chunk_id", F.concat(F.lit(" "), F.array_join(X.blank_words(F.col("text")), " "), F.lit(" ")).alias("flat"))
    hit = q.join(flat, "chunk_id").where(F.contains("flat", F.concat(F.lit(" "), F.col("g"), F.lit(" "))))
    return hit.groupBy("query_id").agg(F.count_distinct("g").alias("n_shared"))

"""The exact top-k kernel, the legs over it and near duplicates: against brute force, and without a shuffle of all pairs."""

import math
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuskiln.operators import best, dedup, dense, embed, evaluate, lexical, search


def exchanges(df) -> str:
    """The keys by which the plan of ``df`` shuffles."""
    return " ".join(re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString()))


def corpus(n: int, seed: int = 3) -> list[tuple[str, list[str]]]:
    r = np.random.default_rng(seed)
    ids = [f"c{i:05d}" for i in r.permutation(n)]
    return [(i, [f"w{int(x)}" for x in r.zipf(1.4, r.integers(1, 9)) % 30]) for i in ids]


def test_counted_terms_with_many_ties():
    rows, asked = corpus(5000), [["w1"], ["w1", "w2"], ["w3", "w4", "w5", "w29"], ["nowhere"]] * 40
    k = 7
    queries, words = best.by_words(list(range(len(asked))), asked)
    run = best.search(queries, len(words), k, lambda x: best.word_cells(x, pa.array(words), lambda tf, term, size: 1 + np.log(tf)), (pa.int64(), pa.string()), 9, counted=True)
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[lo : lo + 900]]), pa.array([r[1] for r in rows[lo : lo + 900]])], names=["id", "w"]) for lo in range(0, 5000, 900)]
    got = sorted((q, -m, -s, c) for b in run(iter(batches)) for q, c, m, s in zip(*(x.to_pylist() for x in b.columns)))
    want = []
    for q, terms in enumerate(asked):
        own = []
        for c, w in rows:
            tf = [w.count(t) for t in terms if t in w]
            if tf:
                own.append((q, -len(tf), -round(sum(1 + math.log(x) for x in tf), 9), c))
        want += sorted(own)[:k]
    assert got == want


def test_bm25_shuffles_no_pairs(spark):
    rows = [(c, " ".join(w)) for c, w in corpus(600)]
    c = spark.createDataFrame([*rows, ("null", None), ("blank", " ")], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "w1 w2"), (2, "W3 w3 w28"), (3, "nowhere"), (4, None)], "query_id int, text string")
    top = lexical.bm25_topk(c, q, 9)
    assert "chunk_id" not in exchanges(top)
    n, lens = len(rows) + 2, [len(t.split()) for _, t in rows] + [0]
    avgdl, want = sum(lens) / len(lens), set()
    for query, terms in ((1, ["w1", "w2"]), (2, ["w3", "w28"])):
        df = {t: sum(t in x.split() for _, x in rows) for t in terms}
        score = {}
        for i, x in rows:
            w = x.split()
            if any(t in w for t in terms):
                score[i] = round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avgdl)) for t in terms if t in w), 6)
        want |= {(query, i, s, r + 1) for r, (i, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:9])}
    assert {tuple(r) for r in top.select("query_id", "chunk_id", "score", "rank").collect()} == want


def moved(spark, make) -> int:
    """Records that are shuffled, and rows that are written in between, by the DataFrame that ``make`` gives."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def total() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() + stages.apply(i).outputRecords() for i in range(stages.size()))

    before = total()
    make().write.format("noop").mode("overwrite").save()
    return total() - before


def legs(c, q, k=5):
    return dense.sparse_topk(embed.hashed(c), embed.hashed(q, "query_id"), k).select("query_id", "chunk_id", "rank").union(lexical.lexical_topk(c, q, k).select("query_id", "chunk_id", "rank"))


def metrics(c, q):
    golden = q.select("query_id", F.array(F.lit("c00001")).alias("relevant_chunk_ids"), F.lit("s").alias("stratum"), F.lit("text").alias("block_type"), F.lit("web").alias("source_type"))
    return evaluate.per_question(found(c, q).withColumnRenamed("final_rank", "rank"), golden)


def found(c, q):
    return search.search_chunks(c, embed.hashed(c), q, embed.hashed(q, "query_id"), 5, 5, 5)


USES = {
    "bm25_topk": lambda c, q: lexical.bm25_topk(c, q, 5),
    "lexical_topk": lambda c, q: lexical.lexical_topk(c, q, 5),
    "eval_diff": lambda c, q: evaluate.diff(evaluate.report(metrics(c, q)), evaluate.report(metrics(c, q))),
    "retrieve_files": lambda c, q: search.retrieve_files(c, q, k_dense=5, k_lexical=5, expand=False),
    "eval_metrics": metrics,
    "quick_retrieve": lambda c, q: search.quick_retrieve(c, q, each=5),
    "retrieve_hits": lambda c, q: search.retrieve(c, embed.hashed(c), q, None, 5, 5, reranking=True),
    "search_chunks": found,
    "eval_report": lambda c, q: evaluate.report(metrics(c, q)),
    "rrf_fuse": lambda c, q: search.rrf(legs(c, q)),
}


@pytest.mark.parametrize("name", USES)
def test_pairs_stay_in_their_task(spark, name):
    """2,000 rows and 100 questions share words nearly all: far fewer records move than there are pairs."""
    c = spark.createDataFrame([(i, " ".join(w), False, *[None] * 8) for i, w in corpus(2000)], "chunk_id string, text string, is_parent boolean, section string, source_id string, page int, url string, parent_id string, chunk_index int, title string, lang string")
    q = spark.createDataFrame([(i, f"w1 w2 w{i % 30}") for i in range(100)], "query_id int, text string")
    n = moved(spark, lambda: USES[name](c, q))
    assert n < 60_000


@pytest.mark.parametrize("name", ["near_links", "near_dedup"])
def test_far_pairs_are_not_written(spark, name):
    """Texts that share half of their words share a band often: they are told apart in the join."""
    r = np.random.default_rng(5)
    texts = [[f"w{x}" for x in r.permutation(64)[:42]] for _ in range(500)]
    texts += [[*t[:-1], "other"] for t in texts[:20]] + texts[:10]
    c = spark.createDataFrame([(f"c{i:05d}", " ".join(t), False) for i, t in enumerate(texts)], "chunk_id string, text string, is_parent boolean")
    links = lambda: dedup.near_links(c)
    assert moved(spark, links if name == "near_links" else lambda: dedup.near_dedup(c)) < 30_000
    sets, first = [set(t) for t in texts], {}
    for i, x in enumerate(sets):
        first.setdefault(frozenset(x), i)
    own = sorted(first.values())
    want = {(f"c{a:05d}", f"c{b:05d}") for a in own for b in own if a < b and 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b])}
    assert {(x["a"][0], x["b"][0]) for x in links().collect()} == want and len(want) >= 20


def left(spark, least: int = 0) -> int:
    """Bytes of shuffle files on disk; waits a little for ``least``, as they are deleted in the background."""
    for _ in range(100):
        own = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        n = sum(own.apply(i).length() for i in range(own.size()) if own.apply(i).getName().startswith("shuffle_"))
        if n <= least:
            break
        time.sleep(0.05)
    return n


@pytest.mark.parametrize("name", ["near_links", "near_dedup"])
def test_near_duplicates_take_little_disk(spark, name):
    """The words of texts are not written, and the bands of some are not kept on disk while others are shuffled."""
    r = np.random.default_rng(6)
    texts = [[r.bytes(30).hex() for _ in range(40)] for _ in range(1000)]
    texts += [[*t[:-1], "other"] for t in texts[:20]]
    c = spark.createDataFrame([(f"c{i:05d}", " ".join(t), False) for i, t in enumerate(texts)], "chunk_id string, text string, is_parent boolean")
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def written() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).outputBytes() for i in range(stages.size()))

    shuffled, before = left(spark), written()
    found = dedup.near_links(c) if name == "near_links" else dedup.near_dedup(c)
    assert left(spark, shuffled + 60_000) <= shuffled + 60_000
    assert written() - before < sum(len(w) for t in texts for w in t) / 4
    assert found.count() == (20 if name == "near_links" else 1000)

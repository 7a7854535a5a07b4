"""Operators on small inline tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpuskiln import schema
from corpuskiln.operators import chunking, dag, dataset, dedup, dense, embed, evaluate, faithfulness, golden, lexical, rewrite, search, store
from corpuskiln.plans import catalog
from corpuskiln.sources import crawl, files, manifest, pdf
from corpuskiln.streaming import worker


def chunks(spark, rows):
    full = [dict(zip(["chunk_id", "text", "source_type", "source_id", "chunk_index", "is_parent", "parent_id", "extra"], r)) for r in rows]
    return schema.conform(spark.createDataFrame([tuple(x.get(c) for c in ("chunk_id", "text", "source_type", "source_id", "chunk_index", "is_parent", "parent_id", "extra")) for x in full], "chunk_id string, text string, source_type string, source_id string, chunk_index int, is_parent boolean, parent_id string, extra string"))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_chunk_id(spark):
    df = spark.createDataFrame([("pdf", "a.pdf", 0, False)], "t string, s string, i int, p boolean")
    assert df.select(schema.chunk_id(*[F.col(c) for c in "tsip"])).collect()[0][0] == "7576294ea2f29e06"


def test_conform_adds_columns(spark):
    df = schema.conform(spark.createDataFrame([("x", "t", None, "zzz")], "chunk_id string, text string, chunk_index int, other string"))
    r = df.collect()[0]
    assert r["chunk_index"] == 0 and r["url"] is None and "other" not in df.columns


def test_keep_first(spark):
    c = chunks(spark, [("a", "same", "web", "s", 0, False), ("b", " same ", "web", "s", 1, False), ("c", "other", "web", "s", 2, False), ("p", "same", "web", "s", 3, True), ("q", "same", "web", "s", 4, True)])
    assert rows(dedup.keep_first(c, ["chunk_index", "chunk_id"]), "chunk_id") == [("a",), ("c",), ("p",), ("q",)]


def greedy(texts, threshold):
    kept = []
    for i, t in enumerate(texts):
        w = set(t.lower().split())
        if w and not any(len(w & set(texts[k].lower().split())) / len(w | set(texts[k].lower().split())) >= threshold for k in kept):
            kept.append(i)
    return kept


def test_near_dedup_is_greedy(spark):
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base), " ".join([*base[:-1], "x"]), " ".join([*base[:-2], "x", "y"]), "other words here", " ".join(base), ""]
    c = chunks(spark, [(f"c{i}", t, "web", "s", i, False) for i, t in enumerate(texts)])
    got = rows(dedup.near_dedup(c, 0.9), "chunk_id")
    assert got == [(f"c{i}",) for i in greedy(texts, 0.9)]


def test_keep_greedy_chain(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "a int, b int")
    assert rows(dedup.keep_greedy(links), "b") == [(2,), (4,)]


def test_upsert_and_delete(spark):
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    target = spark.createDataFrame([("a", "old", 1, t0), ("b", "keep", 2, t0)], "chunk_id string, text string, chunk_index int, created_at timestamp")
    source = spark.createDataFrame([("a", "new", None, t1), ("c", "add", 3, t1)], target.schema)
    assert rows(store.upsert(target, source), "chunk_id", "text", "chunk_index", "created_at") == [("a", "new", 0, t0), ("b", "keep", 2, t0), ("c", "add", 3, t1)]
    v = target.select("chunk_id", F.lit("m").alias("model"), "created_at")
    nv = source.select("chunk_id", F.lit("n").alias("model"), "created_at")
    assert rows(store.upsert_vectors(v, nv), "chunk_id", "model", "created_at")[0] == ("a", "n", t1)


def test_delete_cascades(spark):
    c = chunks(spark, [("a", "x", "pdf", "s1", 0, False), ("b", "y", "pdf", "s2", 0, False)])
    v = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    left, vec = store.delete_sources(c, v, spark.createDataFrame([("s1",)], "source_id string"))
    assert rows(left, "chunk_id") == [("b",)] and rows(vec, "chunk_id") == [("b",)]


def test_nearest_rank(spark):
    df = spark.createDataFrame([(x,) for x in [5, 1, 3, 2, 4, 4, 9]], "v int").withColumn("g", F.lit(1))
    r = store.nearest_rank(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).collect()[0]
    s = sorted([5, 1, 3, 2, 4, 4, 9])
    assert (r["p10"], r["p50"], r["p90"]) == tuple(s[min(6, int(p * 7))] for p in (0.1, 0.5, 0.9))


def test_rrf_order(spark):
    runs = spark.createDataFrame([(1, "c1", 1), (1, "c2", 2), (1, "c3", 3), (1, "c2", 1), (1, "c1", 2)], "query_id int, chunk_id string, rank int")
    best = dense.ranked(search.rrf(runs), 3, "rrf_score", True).orderBy("rank").collect()
    assert [r["chunk_id"] for r in best] == ["c1", "c2", "c3"]


def test_filters_come_after_the_dense_topk(spark):
    c = chunks(spark, [("a", "x", "pdf", "s", 0, True), ("b", "x", "web", "s", 1, False), ("c", "x", "pdf", "s", 2, False)])
    top = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, chunk_id string, rank int")
    assert rows(dense.after_filter(top, c, source_type="pdf"), "chunk_id", "rank") == [("c", 3)]


def test_dense_blocks_agree(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    e = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None), (98, [1.0])], "vec_id long, embedding array<float>")
    q = e.where("vec_id < 7").select(F.col("vec_id").alias("query_id"), "embedding")
    a, b = (rows(dense.dense_topk(e, q, 5, "vec_id", block=n), "query_id", "chunk_id", "rank") for n in (2, 100))
    u = m.astype("float32").astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = sorted((i, int(j), r + 1) for i in range(7) for r, j in enumerate(np.argsort(1 - u @ u[i], kind="stable")[:5]))
    assert a == b == want


def test_and_before_or(spark):
    c = chunks(spark, [("a", "saturn moon", "pdf", "s", 0, False), ("b", "saturn", "pdf", "s", 1, False), ("c", "moon moon", "pdf", "s", 2, False)])
    q = spark.createDataFrame([(1, "the saturn and moon")], "query_id int, text string")
    assert rows(lexical.lexical_topk(c, q, 1), "chunk_id") == [("a",)]
    assert [r["chunk_id"] for r in lexical.lexical_topk(c, q, 5).orderBy("rank").collect()] == ["a", "c", "b"]


def test_expand_parents(spark):
    c = chunks(spark, [("p1", "PPPP", "pdf", "s", 0, True), ("c1", "a", "pdf", "s", 1, False, "p1"), ("c2", "b", "pdf", "s", 2, False, "p1"), ("c3", "c", "pdf", "s", 3, False, "gone")])
    h = c.where("not is_parent").select(F.lit(1).alias("query_id"), "chunk_id", "parent_id", "text", F.col("chunk_index").alias("rank"))
    assert rows(search.expand_parents(h, c, 100), "chunk_id", "text") == [("c1", "PPPP"), ("c3", "c")]
    assert rows(search.expand_parents(h, c, 4), "chunk_id") == [("c1",)]


def test_rerank_with_a_model(spark):
    h = spark.createDataFrame([(1, "q", "a", "short"), (1, "q", "b", "much longer")], "query_id int, question string, chunk_id string, text string")
    assert [r["chunk_id"] for r in search.rerank(h, 1, lambda pairs: [len(t) for _, t in pairs]).collect()] == ["b"]


def test_rewrite(spark):
    lex = rewrite.lexicon(spark, [["Sūrya", "Surya", "Sun"], ["Candra", "Moon"]])
    q = spark.createDataFrame([(1, "Surya and Moon"), (2, "nothing known")], "query_id int, text string")
    got = rewrite.rewrite(q, "lexicon", lex).orderBy("query_id", "variant_no").collect()
    assert [(r[0], r[1], r[2]) for r in got] == [(1, 0, "Surya and Moon"), (1, 1, "Sūrya and Candra"), (1, 2, "Sun and Moon"), (2, 0, "nothing known")]
    assert rows(rewrite.rewrite(q, "unknown"), "query_id") == [(1,), (2,)]
    assert rows(rewrite.alternative(spark.createDataFrame([("Sūrya",)], "word string"), lex), "alt") == [("Sun",)]


def test_gate(spark):
    passage = "Always switch off the main power before you open the cabinet door. Wear gloves."
    a = spark.createDataFrame([(1, "Switch off the main power before you open the cabinet."), (2, "Paint the whole cabinet bright green every single morning."), (3, ""), (4, "Yes."), (5, "[extractive] anything")], "answer_id int, answer string")
    h = spark.createDataFrame([(i, "c1", passage, 0) for i in range(1, 6)], "answer_id int, chunk_id string, text string, hit_no int")
    got = {r["answer_id"]: (r["ok"], r["cited"]) for r in faithfulness.check(a, h).collect()}
    assert got[1] == (True, ["c1"]) and not got[2][0] and not got[3][0] and not got[4][0] and got[5][0]


def test_gated_answer_widens():
    calls = []
    answer, hits = faithfulness.gated_answer(lambda k: calls.append(k) or ["h"], lambda h: "x", lambda a, h: False, 2)
    assert calls == [None, 4] and answer == faithfulness.REFUSAL and hits == ["h"]
    assert faithfulness.gated_answer(lambda k: [], lambda h: 1 / 0, lambda a, h: True, 2) == (faithfulness.NO_CONTEXT, [])
    assert faithfulness.gated_answer(lambda k: ["h"], lambda h: "[extractive] y", lambda a, h: 1 / 0, 2)[0] == "[extractive] y"
    # a wider search without hits ends the loop; the refusal is told what the narrow one found
    assert faithfulness.gated_answer(lambda k: ["h"] if k is None else [], lambda h: "x", lambda a, h: False, 2, refuse=lambda a, h: f"{a}{h}") == ("x['h']", ["h"])


def test_metrics(spark):
    r = spark.createDataFrame([(1, "a", 1, 1, None), (1, "b", 2, None, 1), (1, "c", 3, 2, 2)], "query_id int, chunk_id string, rank int, dense_rank int, lexical_rank int")
    g = spark.createDataFrame([(1, ["b", "z"], "lookup", "text", "pdf"), (2, ["q"], "lookup", "text", "web")], "query_id int, relevant_chunk_ids array<string>, stratum string, block_type string, source_type string")
    m = {x["query_id"]: x for x in evaluate.per_question(r, g).collect()}
    assert m[1]["recall_5"] == 0.5 and m[1]["mrr_10"] == 0.5 and m[1]["first_hit_rank"] == 2 and m[1]["lexical_leg_hits"] == 1 and m[1]["dense_leg_hits"] == 0
    assert abs(m[1]["ndcg_10"] - (1 / 1.584962500721156) / (1 + 1 / 1.584962500721156)) < 1e-9 and m[2]["recall_50"] == 0 and m[2]["first_hit_rank"] is None
    rep = {(x["dimension"], x["segment"]): x["n"] for x in evaluate.report(evaluate.per_question(r, g)).collect()}
    assert rep[("overall", "")] == 2 and rep[("source_type", "web")] == 1 and len(rep) == 5


def test_golden_rows_need_labels(spark):
    with pytest.raises(ValueError):
        evaluate.load_golden(spark.createDataFrame([(1, [])], "query_id int, relevant_chunk_ids array<string>"))


def test_running_lines(spark):
    p = spark.createDataFrame([("d", 1, 0, "HEAD\nbody one"), ("d", 2, 0, "head\nbody two"), ("d", 3, 0, "body three"), ("e", 1, 0, "alone\nx")], "source_id string, page int, pos int, text string")
    assert rows(chunking.strip_running_lines(p), "source_id", "page", "text") == [("d", 1, "body one"), ("d", 2, "body two"), ("d", 3, "body three"), ("e", 1, "alone\nx")]


def test_markdown_blocks(spark):
    p = spark.createDataFrame([("d", 1, "intro\n# One\ntext\nmore\n## Two\n"), ("d", 2, "loose")], "source_id string, page int, text string")
    got = [(r["text"], r["heading"], r["is_heading"]) for r in chunking.markdown_blocks(p).orderBy("block_pos").collect()]
    assert got == [("intro", None, False), ("One", "One", True), ("text\nmore", "One", False), ("Two", "Two", True), ("loose", None, False)]


def test_chunk_documents(spark):
    b = spark.createDataFrame(
        [("d", 0, "One", 1, True, "text"), ("d", 1, "First sentence here. Second one.", 1, False, "text"), ("d", 2, "| a |\n| 1 |", 2, False, "table"), ("d", 3, "Two", 3, True, "text"), ("d", 4, "| b |\n| 2 |", 3, False, "table")],
        "source_id string, block_pos int, text string, page int, is_heading boolean, block_type string",
    )
    docs = spark.createDataFrame([("d", "untitled", "en", "x", 3)], "source_id string, title string, lang string, backend string, page_count int")
    c = chunking.chunk_documents(b, docs, "parent_child").orderBy("chunk_index").collect()
    assert [(r["is_parent"], r["text"], r["page"]) for r in c] == [
        (True, "First sentence here. Second one.", 1), (False, "One\n\nFirst sentence here. Second one.", 1), (False, "One\n\n| a |\n| 1 |", 2), (False, "Two\n\n| b |\n| 2 |", 3),
    ]
    assert c[1]["parent_id"] == c[0]["chunk_id"] and c[3]["parent_id"] is None and c[0]["title"] is None and '"block_type":"table"' in c[2]["extra"]
    assert [r["is_parent"] for r in chunking.chunk_documents(b, docs).collect()].count(True) == 0
    with pytest.raises(ValueError):
        chunking.chunk_documents(b, docs, "no")


def test_chunk_pages_drops_thin(spark):
    p = spark.createDataFrame([("https://www.ex.com/a", "T", "A sentence of the page. " * 20), ("https://ex.com/b", "T", "short")], "url string, title string, text string")
    got = chunking.chunk_pages(p).collect()
    assert {r["url"] for r in got} == {"https://www.ex.com/a"} and got[0]["domain"] == "ex.com"


def test_samples_and_pairs(spark):
    c = chunks(spark, [(f"c{i}", ("not " if i % 2 else "") + "x" * 500, "pdf", f"s{i}", 0, False, None, '{"block_type":"table"}' if i == 9 else "{") for i in range(10)])
    assert rows(golden.sample(c, "numeric", 5), "chunk_id") == [("c9",)]
    assert {r[0] for r in rows(golden.sample(c, "negation", 50), "chunk_id")} == {"c1", "c3", "c5", "c7"}
    assert len(rows(golden.source_pairs(c), "chunk_a")) == 5


def test_leaks(spark):
    c = chunks(spark, [("a", "one two three four five six", "pdf", "s", 0, False)])
    q = spark.createDataFrame([(1, "is one two three four five right", ["a"]), (2, "one two three", ["a"])], "query_id int, text string, relevant_chunk_ids array<string>")
    assert rows(golden.leaks(q, c), "query_id", "n_shared") == [(1, 1)]


def test_split_and_kinds(spark):
    df = spark.createDataFrame([(str(i),) for i in range(57)], "chunk_id string")
    assert dataset.split(df).where("split = 'val'").count() == 5
    c = chunks(spark, [("a", "x", "pdf", "s", 0, True), ("b", "x", "pdf", "s", 1, False, None, '{"block_type":"table"}'), ("c", "x", "pdf", "s", 2, False, None, "broken")])
    assert rows(dataset.kinds(c), "chunk_id", "kind") == [("a", "parents"), ("b", "tables"), ("c", "prose")]


def test_dag():
    done = []

    def do(name):
        done.append(name)
        if name == "b":
            raise RuntimeError

    assert dag.run({"a": [], "b": ["a"], "c": ["b"], "d": ["a", "off"]}, do) == {"a": "ok", "b": "failed", "c": "skipped", "d": "ok"}
    with pytest.raises(ValueError):
        dag.order({"a": ["b"], "b": ["a"]})


def test_files(spark, tmp_path):
    c = chunks(spark, [("a", "täxt", "pdf", "s", 0, False, None, "{bad"), ("b", "y", "web", "t", 1, True)])
    j, p = str(tmp_path / "x.jsonl"), str(tmp_path / "x.parquet")
    files.write_jsonl(c, j)
    files.write_parquet(c, p)
    missing = []
    both = files.combine(spark, [j, p, str(tmp_path / "no.jsonl")], missing.append)
    assert rows(both, "chunk_id") == [("a",), ("a",), ("b",), ("b",)] and len(missing) == 1
    assert {r["extra"] for r in files.read_parquet(spark, p).collect()} == {"{}"}
    assert {r["path"] is None: r["n"] for r in files.rows_per_file(spark, j).collect()}[True] == 2
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"chunk_id": "a"\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(bad)).collect()
    files.write_kinds(c, str(tmp_path / "kinds"))
    assert sorted(x.name for x in (tmp_path / "kinds").rglob("kind=*")) == ["kind=parents", "kind=prose"]
    with pytest.raises(ValueError):
        files.check_namespace("public")
    (tmp_path / "in").mkdir()
    for n in ("train.jsonl", "c.jsonl"):
        (tmp_path / "in" / n).write_text("{}\n")
    assert [x.rsplit("/", 1)[1] for x in files.chunk_paths(spark, [str(tmp_path / "in"), str(tmp_path / "in"), str(tmp_path / "none")])] == ["c.jsonl"]


def test_pdf_hook(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.pdf").write_bytes(b"%PDF page one")
    (tmp_path / "in" / "b.pdf").write_bytes(b"broken")

    def fake(data):
        if not data.startswith(b"%PDF"):
            raise ValueError("no PDF")
        return [(1, "# Title\n" + data.decode()), (2, "")]

    f = pdf.scan(spark, str(tmp_path / "in"))
    p = pdf.pages(f, extract=fake)
    assert rows(p.where("error is null"), "source_id", "page") == [("deep/a.pdf", 1), ("deep/a.pdf", 2)]
    assert rows(p.where("error is not null"), "source_id") == [("b.pdf",)]
    assert rows(pdf.scanned_share(p.where("error is null")), "scanned_share") == [(1.0,)]
    with pytest.raises(ValueError):
        pdf.backend("unheard of")


def test_crawl(spark):
    site = [("https://ex.com/", ["https://ex.com/lesson", "https://ex.com/login", "https://off.org/", "https://ex.com/a.css"]), ("https://ex.com/lesson", ["https://ex.com/", "https://ex.com/private/x"]), ("https://ex.com/private/x", [])]
    pages = spark.createDataFrame(site, "url string, links array<string>")
    seeds = spark.createDataFrame([("https://ex.com",)], "seed string")
    robots = spark.createDataFrame([("https://ex.com", "# none\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /private/open\nDisallow: /private # closed\n")], "origin string, body string")
    rules = crawl.robots_rules(robots, "bot/1.0")
    assert rows(crawl.crawl(seeds, crawl.from_table(pages), robots=rules), "url", "depth") == [("https://ex.com/", 0), ("https://ex.com/lesson", 1)]
    assert crawl.crawl(seeds, crawl.from_table(pages), robots=crawl.robots_rules(robots, "Other/2")).count() == 0
    links = spark.createDataFrame([("https://ex.com/private/open/a",), ("https://ex.com/private",), ("https://no.example/private",)], "url string")
    assert rows(crawl.robots_allowed(links, rules), "url") == [("https://ex.com/private/open/a",), ("https://no.example/private",)]
    assert crawl.crawl(spark.createDataFrame([("https://ex.com/login",)], "seed string"), crawl.from_table(pages)).count() == 0
    dead = spark.createDataFrame([("https://ex.com/", [f"https://ex.com/{i}" for i in range(40)])], "url string, links array<string>")
    seen = []
    fetch = crawl.from_table(dead)

    def counted(want):
        seen.append(want.count())
        return fetch(want)

    assert crawl.crawl(seeds, counted, per_seed=5).count() == 1 and sum(seen) == 5


def test_crawl_lists_pdfs_and_goes_deep(spark):
    seeds = spark.createDataFrame([("https://ex.com/",)], "seed string")
    site = [("https://ex.com/", ["https://ex.com/a.pdf", "https://ex.com/b.PDF?x=1", "https://ex.com/p", "https://ex.com/q"]), ("https://ex.com/p", []), ("https://ex.com/q", [])]
    pages = spark.createDataFrame(site, "url string, links array<string>")
    got = crawl.crawl(seeds, crawl.from_table(pages))
    assert rows(got, "kind", "depth") == [("page", 0), ("page", 1), ("page", 1), ("pdf", 1), ("pdf", 1)]
    assert rows(crawl.pdf_links(got.where("kind = 'pdf'")), "filename") == [("a.pdf",), ("b.PDF",)]
    # PDFs use up both budgets
    assert rows(crawl.crawl(seeds, crawl.from_table(pages), per_seed=3), "kind") == [("page",), ("pdf",), ("pdf",)]
    assert rows(crawl.crawl(seeds, crawl.from_table(pages), max_pages=2), "kind") == [("page",), ("pdf",)]
    typed = lambda want: crawl.from_table(pages)(want).withColumn("is_pdf", F.col("url").endswith("/q"))
    assert rows(crawl.crawl(seeds, typed).where("kind = 'pdf'"), "url")[-1] == ("https://ex.com/q",)
    body = crawl.hand_off(got, lambda u: b"%PDF-1" if "a.pdf" in u else b"<html>", "web")
    assert rows(body, "source_id", "namespace") == [("a.pdf", "web")]
    with pytest.raises(ValueError):
        crawl.hand_off(got, lambda u: b"", "public")


def test_manifest(spark):
    f = spark.createDataFrame([("a", 1.7, 10), ("b", 2.0, 20), ("c", 3.0, 30)], "path string, mtime double, size int")
    m = spark.createDataFrame([("a", 1, 10), ("b", 1, 20)], "path string, mtime long, size int")
    new = manifest.changed(f, m)
    assert rows(new, "path") == [("b",), ("c",)]
    assert rows(manifest.mark(m, new, new.where("path = 'c'")), "path", "mtime") == [("a", 1), ("b", 2)]


def test_worker_survives_a_bad_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"chunk_id": "a", "text": "x"}\n')
    got, failures = [], []

    def step(df, batch):
        got.append(df.count())
        raise RuntimeError("no")

    worker.watch_chunks(spark, str(tmp_path / "in"), step, str(tmp_path / "cp"), failures=failures).awaitTermination(60)
    assert got == [1] and len(failures) == 1


def test_embedding(spark):
    c = chunks(spark, [("a", "Saturn saturn moon", "pdf", "s", 0, False), ("b", "", "pdf", "s", 1, False)])
    v = embed.Embedder(dim=64).transform(c).collect()
    assert len(v) == 1 and abs(sum(x * x for x in v[0]["embedding"]) - 1) < 1e-6
    m = embed.Embedder("model", 2, encode=lambda t: [[len(x), 1] for x in t]).transform(c).collect()
    assert sorted(r["embedding"][0] for r in m) == [0.0, 18.0]
    w = worker.embed_missing(c, spark.createDataFrame([("a",)], "chunk_id string"))
    assert w.count() == 0


def test_snapshot(spark):
    t = spark.createDataFrame([("a", dt.datetime(2024, 1, 1))], "chunk_id string, created_at timestamp")
    due, now = worker.snapshot_due(t, t.limit(0), None)
    assert due and not worker.snapshot_due(t, t.limit(0), now)[0] and not worker.snapshot_due(t.limit(0), t.limit(0), None)[0]
    assert store.keep_last(["c", "a", "b"], 2) == ["a"]


def test_semantic_windows(spark):
    s = spark.createDataFrame([(1, 0, "a", [1.0, 0.0]), (1, 1, "b", [1.0, 0.0]), (1, 2, "c", [0.0, 1.0]), (1, 3, "d", [0.0, 1.0])], "doc int, pos int, sentence string, embedding array<double>")
    assert rows(chunking.semantic_windows(s, 100, ["doc"]), "window_no", "text") == [(0, "a b"), (1, "c d")]


def test_empty_tables(spark):
    c = chunks(spark, [("a", "x", "pdf", "s", 0, False)]).limit(0)
    q = spark.createDataFrame([], "query_id int, text string")
    assert dedup.near_dedup(c).count() == 0 and lexical.lexical_topk(c, q, 5).count() == 0 and lexical.bm25_topk(c, q, 5).count() == 0
    assert search.search_chunks(c, embed.hashed(c), q, embed.hashed(q, "query_id")).count() == 0
    assert dense.dense_topk(spark.createDataFrame([], "vec_id long, embedding array<float>"), spark.createDataFrame([], "query_id long, embedding array<float>"), 3, "vec_id").count() == 0


def test_semantic_chunks_by_an_embedder(spark):
    said = "Mars is red. Mars is far. The sea is deep. The sea is salt. ..."
    b = spark.createDataFrame([("d", 0, "Head", 1, True, "text"), ("d", 1, said, 1, False, "text"), ("d", 2, "|a|b|", 1, False, "table"), ("e", 0, "|c|d|", 1, False, "table")], "source_id string, block_pos int, text string, page int, is_heading boolean, block_type string")
    docs = spark.createDataFrame([("d", "T", "en", "x", 1), ("e", "U", "en", "x", 1)], "source_id string, title string, lang string, backend string, page_count int")
    model = embed.Embedder("model", 2, lambda texts: [[3.0, 0.0] if "Mars" in t else [0.0, 2.0] for t in texts])
    got = rows(chunking.chunk_documents(b, docs, "semantic", embedder=model), "source_id", "chunk_index", "text", "overlap_tokens")
    assert [x[2] for x in got] == ["Head\n\nMars is red. Mars is far.", "Head\n\nThe sea is deep. The sea is salt. ...", "Head\n\n|a|b|", "|c|d|"]
    assert [x[3] for x in got] == [0, 60, 0, 0]
    assert chunking.chunk_documents(b, docs, "semantic").count() == 3


def test_semantic_windows_cover_every_section(spark):
    d = "/root/testdata/sf0.001"
    b = catalog.blocks(spark, d)
    want = {(r[0], r[1]): r[2] for r in chunking.section_sentences(b).groupBy("source_id", "section_no").agg(F.sum(F.length("sentence") + 1)).collect()}
    got = {(r[0], r[1]): r[2] for r in chunking.semantic_sections(b, embed.Embedder(dim=256), 60).groupBy("source_id", "section_no").agg(F.sum(F.length("text") + 1)).collect()}
    assert got == want and {k[0] for k in got} == {r[0] for r in b.where("not is_heading and block_type = 'text'").select("source_id").distinct().collect()}

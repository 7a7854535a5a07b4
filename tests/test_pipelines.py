"""Pipelines, writers, hooks and the command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corpuskiln import __main__ as cli
from corpuskiln.functions import text as X
from corpuskiln.functions import urls as U
from corpuskiln.operators import chunking, dataset, embed, evaluate, golden, rewrite, search, store
from corpuskiln.plans import pipelines
from corpuskiln.schema import conform
from corpuskiln.session import discard, scope, settle
from corpuskiln.sources import crawl, files, pdf
from corpuskiln.streaming import worker

PROSE = "The lord of the ninth house rules the harvest of the village and the season of rain. The moon in the fourth house is favourable for journeys by water. A strong Saturn delays the wedding but steadies the family. "


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).collect()[0]["y"]


A, B = "Chandra Mangala Budha Brihas Shukra Shanaish Ketuvan".split(), "Mesha Vrisha Mithuna Karka Simha".split()


def chunk_table(spark, n=40):
    data = [(f"c{i:03d}", f"{PROSE} {A[i % 7]} stands with {B[i % 5]} in this chart, and {A[i % 7]} decides. " * 3, "pdf", f"s{i % 4}.pdf", i, False, f"Section of {A[i % 7]}") for i in range(n)]
    return conform(spark.createDataFrame(data, "chunk_id string, text string, source_type string, source_id string, chunk_index int, is_parent boolean, section string"))


def test_html_text(spark):
    page = "<html><head><title>A &amp;\n B</title><script>if (a<b) { x('</p>') }</script><style>p {}</style></head><body><h2>One&nbsp;two</h2><svg><text>no</text></svg>x<br/>y &eacute;&#233;&#x41; &lt;b&gt; &amp;lt;<!-- <p>no</p> --><p>z</p></body></html>"
    assert one(spark, page, X.html_title) == "A & B"
    assert one(spark, page, X.html_text).endswith("One\u00a0two\n\n x\ny éé" + "A <b> &lt; z")
    assert one(spark, "<p>menu</p><p>main</p>", lambda c: X.html_text(c, lambda h: "main" if "main" in h else None)) == "main"
    assert one(spark, "<p>menu</p>", lambda c: X.html_text(c, lambda h: None)) == "menu"


def test_sentences_of_a_long_text(spark):
    text = "See Fig. 2 here. " * 5000
    got = one(spark, text, X.sentences)
    assert len(got) == 5000 and set(got) == {"See Fig. 2 here."}


def test_fold(spark):
    assert one(spark, "Bṛhaspati ÉCOLE Śani ñ 12 हिन्दी", X.fold_diacritics)[:22] == "brhaspati ecole sani n"
    assert one(spark, "e\u0308X ẗ", X.fold_diacritics) == "ex t"


def test_resolution_after_the_standard(spark):
    base = "http://a/b/c/d?q"
    want = {"g": "http://a/b/c/g", "./g": "http://a/b/c/g", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d?q#s", "..": "http://a/b/", "../g": "http://a/b/g", "../../g": "http://a/g", "../../../g": "http://a/g", "g:h": "g:h", "": "http://a/b/c/d?q", "./g/.": "http://a/b/c/g/"}
    got = {r["r"]: r["u"] for r in spark.createDataFrame([(k,) for k in want], "r string").select("r", U.resolve_reference(F.col("r"), F.lit(base)).alias("u")).collect()}
    assert got == want
    assert one(spark, "menu/g", lambda c: U.resolve_href(c, F.lit(base))) == "http://a/menu/g"


def test_spans_against_the_rule():
    import random

    rng = random.Random(3)
    for _ in range(300):
        t = [rng.randint(1, 30) for _ in range(rng.randint(0, 25))]
        w = chunking.spans(t, 40, 9)
        assert (w[0][0], w[-1][1]) == (0, len(t)) if t else w == []
        for (a, b, _), nxt in zip(w, [*w[1:], None]):
            assert sum(t[a:b]) <= 40 or b == a + 1
            assert b == len(t) or sum(t[a : b + 1]) > 40
            if nxt:
                assert a < nxt[0] <= b and (sum(t[nxt[0] : b]) >= 9 or nxt[0] == a + 1) and (nxt[0] == b or sum(t[nxt[0] + 1 : b]) < 9 or nxt[0] + 1 > b)


def test_scope_removes_tables(spark):
    df = spark.range(3)
    with scope(spark):
        t = settle(df, "scoped")
        assert t.count() == 3 and os.path.isdir(t._settled_path)
    assert not os.path.isdir(t._settled_path)
    t = settle(df, "kept")
    discard(t.where("id > 0"))
    assert os.path.isdir(t._settled_path)
    discard(t)
    assert not os.path.isdir(t._settled_path)


def test_pdf_folder(spark, tmp_path):
    prose = PROSE

    def fake_pdf(data):
        if not data.startswith(b"%PDF"):
            raise ValueError("no PDF")
        n = data[4:].decode()
        return [(1, f"RUNNING TITLE\n# Book {n}\n{prose * 4}"), (2, f"RUNNING TITLE\n## Part\n{prose * 3}{n}"), (3, "")]

    (tmp_path / "in" / "x").mkdir(parents=True)
    (tmp_path / "in" / "x" / "a.pdf").write_bytes(b"%PDFone")
    (tmp_path / "in" / "b.pdf").write_bytes(b"broken")
    ocr = lambda data: [(1, fake_pdf(data)[0][1]), (2, fake_pdf(data)[1][1]), (3, "# Third\nread by the engine. " + prose)]
    extras = lambda data: [(2, "table", [["a", "b"], ["1", None], ["2", "3"]]), (2, "figure", "xx")]
    chunks, failures, done = pipelines.pdf_folder(spark, str(tmp_path / "in"), extract=fake_pdf, ocr=ocr, extras=extras, detect=lambda t: "en")
    got = chunks.collect()
    assert {r["source_id"] for r in got} == {"x/a.pdf"} and {r["title"] for r in got} == {"Book one"} and {r["lang"] for r in got} == {"en"}
    assert not any("RUNNING" in r["text"] for r in got) and any("read by the engine" in r["text"] for r in got) and any("| 2 | 3 |" in r["text"] for r in got)
    assert all(r["parent_id"] for r in got if not r["is_parent"] and "|" not in r["text"]) and len({r["chunk_id"] for r in got}) == len(got)
    assert rows(failures, "source_id") == [("b.pdf",)] and [os.path.basename(r["path"]) for r in done.collect()] == ["a.pdf"]
    again, _, _ = pipelines.pdf_folder(spark, str(tmp_path / "in"), done=settle(done, "done"), extract=fake_pdf)
    assert again.count() == 0


def test_web_chunks_and_ingest(spark):
    html = lambda n: f"<html><title>Page {n}</title><body><p>{PROSE * 6} {n}</p></body></html>"
    links = spark.createDataFrame([("https://ex.com/", ["https://ex.com/a", "https://ex.com/copy", "https://ex.com/f.pdf"]), ("https://ex.com/a", []), ("https://ex.com/copy", [])], "url string, links array<string>")
    bodies = spark.createDataFrame([("https://ex.com/", html("home " * 3)), ("https://ex.com/a", "<p>thin</p>"), ("https://ex.com/copy", html("home " * 3))], "url string, html string")
    seeds = spark.createDataFrame([("https://ex.com/",)], "seed string")
    chunks, pdfs = pipelines.web_chunks(seeds, crawl.from_table(links), bodies)
    chunks = settle(chunks, "web")
    assert {r["source_id"] for r in chunks.collect()} == {"https://ex.com/"} and rows(pdfs, "filename") == [("f.pdf",)]
    old = conform(spark.createDataFrame([("old", "x y z", "web", "https://ex.com/", 0, False)], "chunk_id string, text string, source_type string, source_id string, chunk_index int, is_parent boolean"))
    vec = spark.createDataFrame([("old", [0.0], "hashing", None)], "chunk_id string, embedding array<float>, model string, created_at timestamp")
    c, v = pipelines.ingest(old, vec, chunks)
    assert rows(c, "chunk_id") == rows(chunks, "chunk_id") == rows(v, "chunk_id")


def test_read_sound(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"chunk_id": "a", "text": "x", "is_parent": false}\n\n')
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "bad.jsonl").write_text('{"chunk_id": "b", "text": "y"}\n{"chunk_id": \n')
    warned = []
    assert rows(files.read_sound(spark, str(tmp_path), warn=warned.append), "chunk_id") == [("a",)] and len(warned) == 1 and "bad" in warned[0]


def test_kinds_keep_folders_apart(spark, tmp_path):
    c = conform(spark.createDataFrame([("a", "x", "pdf", "one/x.pdf", 0, False), ("b", "y", "pdf", "two/x.pdf", 0, False)], "chunk_id string, text string, source_type string, source_id string, chunk_index int, is_parent boolean"))
    files.write_kinds(c, str(tmp_path / "k"))
    assert len(list((tmp_path / "k").glob("stem=*"))) == 2


def test_sets_snapshot_report(spark, tmp_path):
    c = chunk_table(spark)
    assert dataset.write_sets(c, str(tmp_path / "sets"), question=lambda t: "Why?" if "Brihas" in t else None) == {"train": 36, "val": 4}
    assert spark.read.json(str(tmp_path / "sets" / "train.jsonl")).where("instruction = 'Why?'").count() > 0
    for k in range(4):
        left = store.snapshot({"chunks": c.limit(2)}, str(tmp_path / "snap"), f"2024010{k}-000000", keep=2)
    assert left == ["20240102-000000", "20240103-000000"] and sorted(p.name for p in (tmp_path / "snap").iterdir()) == left
    r = spark.createDataFrame([(1, "lookup", "text", "pdf", 3, 0.5, 0.5, 0.5, 0.5, 1.0, 0.5, 1, 1, 0)], "query_id int, stratum string, block_type string, source_type string, candidates int, recall_5 double, recall_10 double, recall_20 double, recall_50 double, mrr_10 double, ndcg_10 double, first_hit_rank int, dense_leg_hits int, lexical_leg_hits int")
    evaluate.write_report(evaluate.report(r), str(tmp_path / "report"), {"k": 5})
    out = json.loads(next((tmp_path / "report").glob("*.json")).read_text())
    assert out["report"]["stratum"]["lookup"]["recall_5"] == 0.5 and json.loads(out["_meta"]) == {"k": 5}
    j = spark.createDataFrame([("q", "a", ["c"]), ("x", None, None)], "question string, answer string, contexts array<string>")
    assert rows(evaluate.judged(j, lambda q, a, c: {"f": float(len(c))} if a else 1 / 0, ["f"]), "question", "f") == [("q", 1.0), ("x", None)]


def test_last_of_stored(spark, monkeypatch):
    data = [("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, "p"), (None, 1, "q"), (None, 2, "r")]
    df = spark.createDataFrame(data, "k string, t int, v string")
    want = rows(store.last_wins(df, "k", ["t"]), "t", "v")
    assert rows(store.last_of_stored(df, "k", ["t"]), "t", "v") == want == [(1, "p"), (2, "r"), (3, "y")]
    monkeypatch.setattr(store, "BROADCAST_LIMIT_BYTES", 0)
    assert rows(store.last_of_stored(df, "k", ["t"]), "t", "v") == want
    assert store.last_of_stored(df.limit(0), "k", ["t"]).count() == 0


def test_store_helpers(spark, tmp_path):
    c = chunk_table(spark, 5)
    assert rows(store.by_ids(c, ["c001", "c003", "c001", "zz"]), "chunk_id") == [("c001",), ("c003",)] and store.by_ids(c, []).count() == 0
    seen, o = store.counted(c, "stats")
    seen.write.format("noop").mode("overwrite").save()
    assert o.get["n"] == 5 and o.get["n_parents"] == 0
    for _ in range(2):
        store.create_tables(spark, "kiln_test", f"file://{tmp_path}/db")
    assert spark.table("kiln_test.chunks").columns[0] == "chunk_id"
    spark.sql("DROP DATABASE kiln_test CASCADE")


def test_stores_in_files(spark, tmp_path):
    c = chunk_table(spark, 6)
    embed.save_store(c, embed.hashed(c), str(tmp_path / "s"))
    a, b = embed.load_store(spark, str(tmp_path / "s"))
    assert a.count() == b.count() == 6
    want = rows(golden.doc_freq(c), "term", "df")
    assert rows(golden.stored_doc_freq(c, str(tmp_path / "df")), "term", "df") == want == rows(golden.stored_doc_freq(c.limit(0), str(tmp_path / "df")), "term", "df")


def test_ask_a_folder(spark, tmp_path, capsys):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    prose = PROSE
    pdf.register("made", lambda data: [(1, f"# Book\n{prose}")])
    assert cli.main(["ask", str(tmp_path), "What is favourable for journeys?", "--backend", "made"], spark) == 0
    assert capsys.readouterr().out.startswith("[extractive]")


def test_rewriters_and_golden_build(spark):
    terms = rewrite.lexicon(spark, [["Sūrya", "Surya", "Sun"], ["Mesha", "Meṣa"]])
    q = spark.createDataFrame([(1, "When is sūrya strong?"), (2, "no term")], "query_id int, text string")
    assert rows(rewrite.respelled(q, terms), "query_id", "text") == [(1, "When is Sun strong?"), (2, "no term")]
    rewrite.register("mine", rewrite.model_rewriter(lambda t: [t.upper(), t]))
    assert rows(rewrite.rewrite(q, "mine"), "query_id", "variant_no", "text")[1] == (1, 1, "WHEN IS SŪRYA STRONG?")
    c = settle(chunk_table(spark), "golden-test")
    g = golden.build(c, 3, lexicon=terms).collect()
    assert g and len({r["question_id"] for r in g}) == len(g) and max([r["stratum"] for r in g].count(s) for s in golden.STRATA) <= 3
    assert all(len(set(r["source_ids"])) == 2 for r in g if r["stratum"] == "synthesis")
    m = golden.build(c, 2, golden.model_questions(lambda s, t: (f"{s}?", "a") if s == "lookup" else None)).collect()
    assert {r["stratum"] for r in m} == {"lookup"} and len(m) == 2


def test_retrievers(spark):
    c = settle(chunk_table(spark), "retrieve-test")
    q = spark.createDataFrame([(1, "Brihas and Mithuna"), (2, "zzz")], "query_id int, text string")
    hits = search.retrieve_files(c, q, k_final=3).collect()
    assert {r["query_id"] for r in hits} == {1} and len(hits) == 3 and all("Brihas" in r["text"] or "Mithuna" in r["text"] for r in hits)
    both = search.retrieve_files(c, q, embed.hashed(c), embed.hashed(q, "query_id"), k_final=3, reranking=True)
    assert both.where("query_id = 1").count() == 3
    assert search.quick_retrieve(c, q).where("query_id = 1").count() == 5
    assert search.choose_retriever(True, c, c) == "store" and search.choose_retriever(False, c, None) == "files"
    for bad in ((True, c, None), (False, None, None)):
        with pytest.raises(RuntimeError):
            search.choose_retriever(*bad)
    search.register_search_function(c, settle(embed.sparse(c), "sparse-test"), "fn")
    for text in ("Brihas and Mithuna", "moon in the fourth house"):  # any question, not one asked before
        want = [r["chunk_id"] for r in search.search_text(c, embed.hashed(c), text).collect()]
        got = [r["chunk_id"] for r in spark.sql(f"SELECT chunk_id, rrf_score FROM search_hits('{text}') ORDER BY rrf_score DESC, chunk_id").collect()]
        assert len(want) == 6 and sorted(got) == sorted(want)
    assert spark.sql("SELECT * FROM search_hits('moon', 3, NULL, 's1.pdf')").select("source_id").distinct().collect()[0][0] == "s1.pdf"


def test_rounds_go_on_after_a_failure():
    failures = []
    assert worker.every(0.0, lambda n: 1 / n, rounds=3, failures=failures) == 3 and len(failures) == 1


def test_command_line(spark, tmp_path, capsys):
    files.write_parquet(chunk_table(spark), str(tmp_path / "c.parquet"))
    run = lambda *a: cli.main([str(x) for x in a], spark)
    assert run("embed", tmp_path / "c.parquet", tmp_path / "v") == 0 and spark.read.parquet(str(tmp_path / "v")).count() == 40
    assert run("search", tmp_path / "c.parquet", "Brihas") == 0 and "c0" in capsys.readouterr().out
    assert run("sets", tmp_path / "c.parquet", tmp_path / "sets") == 0
    assert run("report", tmp_path / "c.parquet") == 0 and run("query", "nothing", tmp_path, tmp_path / "q") == 2
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["unheard-of"])

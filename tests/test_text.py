"""Text, URL and vector expressions against plain Python."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuskiln.functions import text as X
from corpuskiln.functions import urls as U
from corpuskiln.functions import vectors as V
from corpuskiln.operators import chunking


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).collect()[0][0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("See Fig. 2 for it. Next one.", ["See Fig. 2 for it.", "Next one."]),
        ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ("  Dr. Who came.  Then Mr. Smith left. ", ["Dr. Who came.", "Then Mr. Smith left."]),
        ("", []),
        ("no end here", ["no end here"]),
    ],
)
def test_sentences(spark, text, want):
    assert one(spark, text, X.sentences) == want


def test_tokens_and_strip(spark):
    assert one(spark, "abc", X.count_tokens) == 1
    assert one(spark, "a" * 41, X.count_tokens) == 10
    assert one(spark, "  a ", X.py_strip) == "a"
    assert one(spark, "Straße", X.casefold) == "strasse"
    assert one(spark, "abcdefgh", lambda c: X.truncate_tokens(c, 1)) == "abcd"


def test_headings_and_titles(spark):
    assert one(spark, "## *Two* words", X.heading_level) == 2
    assert one(spark, "#hash", X.heading_level) == 0
    assert one(spark, "*Two* words", X.clean_heading) == "Two words"
    assert one(spark, " Untitled ", X.real_title) is None
    assert one(spark, "Real", X.real_title) == "Real"
    assert one(spark, "H\n\nbody", lambda c: X.with_heading(F.lit("H"), c)) == "H\n\nbody"
    assert one(spark, "body", lambda c: X.with_heading(F.lit("H"), c)) == "H\n\nbody"
    assert one(spark, "  A \t b ", X.line_key) == "a b"


def test_html(spark):
    html = "<html><head><title> A &amp;\n B </title><script>x<y</script></head><body><h1>Hi</h1><p>One<br/>two</p><!-- no -->&lt;tag&gt;</body></html>"
    assert one(spark, html, X.html_title) == "A & B"
    assert one(spark, "<p>x</p>", X.html_title) is None
    text = one(spark, html, X.html_text)
    assert "x<y" not in text and "One\ntwo" in text and text.endswith("<tag>") and "no" not in text.split("two")[1]


def test_tables_and_figures(spark):
    assert one(spark, "| a | b |\n| --- | --- |\n| 1 | 2 |\n|  |  |", lambda c: F.size(X.table_rows(c))) == 2
    assert one(spark, [["a", "b"], ["1", None]], X.markdown_table, "array<array<string>>") == "| a | b |\n| --- | --- |\n| 1 |  |"
    assert one(spark, "x" * 50, X.keep_figure_text) is True
    assert one(spark, "1 2 3 " * 10, X.keep_figure_text) is False


def test_ngrams(spark):
    assert one(spark, "a b c d e f", lambda c: X.ngrams(X.blank_words(c), 5)) == ["a b c d e", "b c d e f"]
    assert one(spark, "a b", lambda c: X.ngrams(X.blank_words(c), 5)) == []


@pytest.mark.parametrize(
    "url, want",
    [("HTTPS://Ex.COM/a/#f", "HTTPS://ex.com/a"), ("ex.com", "https://ex.com/"), ("http://www.ex.com/a/?q=1", "http://www.ex.com/a?q=1")],
)
def test_normalize(spark, url, want):
    assert one(spark, url, U.normalize_url) == want


def test_url_predicates(spark):
    yes = lambda url, f: one(spark, url, f)
    assert yes("https://a.ex.com/x", lambda c: U.same_site(c, F.lit("https://www.ex.com/")))
    assert not yes("https://notex.com/x", lambda c: U.same_site(c, F.lit("https://ex.com/")))
    assert yes("https://ex.com/login", U.path_denied) and yes("https://ex.com/login/x", U.path_denied) and not yes("https://ex.com/loginpage", U.path_denied)
    assert yes("https://ex.com/a.ZIP", lambda c: U.has_ending(c, U.BINARY)) and yes("https://ex.com/a.css", lambda c: U.has_ending(c, U.ASSETS))
    assert yes("https://ex.com/c?Name=x&y=1", U.is_generator) and not yes("https://ex.com/c?id=1", U.is_generator)
    assert yes("https://ex.com/a.pdf", U.is_pdf_url)
    assert one(spark, "https://ex.com/a b%20c.pdf", U.pdf_filename) == "a_b_c.pdf"
    assert one(spark, "https://ex.com/", U.pdf_filename) == "download.pdf"


@pytest.mark.parametrize(
    "href, want",
    [
        ("#a", None), ("mailto:x", None), ("https://o.com/x", "https://o.com/x"), ("/r", "https://ex.com/r"), ("p.html", "https://ex.com/d/p.html"),
        ("m/p.html", "https://ex.com/m/p.html"), ("../up.html", "https://ex.com/up.html"), ("//o.com/x", "https://o.com/x"),
    ],
)
def test_resolve(spark, href, want):
    assert one(spark, href, lambda c: U.resolve_href(c, F.lit("https://ex.com/d/i.html"))) == want


def test_links_in_order_once(spark):
    html = """<a href='/a'>x</a> <a href="/a">y</a> <script>go("menu/m.html")</script> <img src="/i.png">"""
    assert one(spark, html, lambda c: U.links(c, F.lit("https://ex.com/d/i.html"))) == ["https://ex.com/a", "https://ex.com/menu/m.html"]


@pytest.mark.parametrize("dim", [1024, 1000, 7])
def test_bucket(spark, dim):
    for w in ("saturn", "é", "x" * 50):
        assert one(spark, w, lambda c: V.bucket(c, dim)) == int(hashlib.md5(w.encode()).hexdigest(), 16) % dim


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>").select(V.norm(F.col("a")), V.cosine_distance(F.col("a"), F.col("b")), V.normalized(F.col("a"))).collect()[0]
    assert r[0] == 5.0 and abs(r[1] - 0.04) < 1e-12 and r[2] == [0.6, 0.8]


def reference_windows(tokens, target, overlap):
    """The rule said directly: fill, then step back until the overlap is reached."""
    out, i = [], 0
    while i < len(tokens):
        j, s = i, 0
        while j < len(tokens) and (j == i or s + tokens[j] <= target):
            s += tokens[j]
            j += 1
        out.append((i, j, 0 if not out else overlap))
        if j >= len(tokens):
            break
        k = max([x for x in range(i, j) if sum(tokens[x:j]) >= overlap], default=i)
        i = max(k, i + 1)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40), st.integers(1, 60), st.integers(1, 30))
def test_spans(tokens, target, overlap):
    assert chunking.spans(tokens, target, overlap) == reference_windows(tokens, target, overlap)


def test_pack_merges_a_short_tail(spark):
    text = " ".join(f"Sentence number {i} is here now." for i in range(9)) + " End."
    df = spark.createDataFrame([(1, text)], "id int, text string")
    full = chunking.pack_texts(df, "id", target=20, share=0.2, min_tokens=0).orderBy("window_no").collect()
    merged = chunking.pack_texts(df, "id", target=20, share=0.2, min_tokens=15).orderBy("window_no").collect()
    assert len(merged) <= len(full) and merged[-1]["text"].endswith("End.") and full[0]["overlap_tokens"] == 0
    assert all(re.match("Sentence", w["text"]) or "End." in w["text"] for w in full)

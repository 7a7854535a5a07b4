import random
import re

from corpuskiln.llm import sitelines as S


def brute(data, min_pages=5, share=0.1):
    pages, on, occ = {}, {}, []
    for cid, text, site, page in data:
        if site is None or text is None:
            continue
        pages.setdefault(site, set()).add(page)
        for i, line in enumerate(text.split("\n")):
            if re.search(r"[^\W\d_]", line):
                k = (site, re.sub(r"\d+", "0", re.sub(r"\s+", "", line.lower())))
                on.setdefault(k, set()).add(page)
                occ.append((cid, i, k))
    return sorted({(c, i) for c, i, k in occ if len(on[k]) >= min_pages and len(on[k]) >= share * len(pages[k[0]])})


def site(n=80, seed=1):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        lines = ["body " + "".join(rng.choices("abcdefgh", k=20)) for _ in range(3)]
        if i % 3 == 0:
            lines = [f"Seen by {i} readers", "  SHARE this  Page", *lines]
        if i % 17 == 0:
            lines.append("Rare notice")
        if i % 2:
            lines += ["", "12345"]
        data.append((f"c{i}", "\n".join(lines), "big" if i % 4 else "small", f"p{i // 2}"))
    return data


def test_against_brute_force(spark):
    data = [*site(), ("n1", None, "big", "p"), ("n2", "Share this page", None, "p"), ("n3", "", "big", "p0"), ("c0", site()[0][1], "small", "p0")]
    df = spark.createDataFrame([(*r, 7, "x") for r in data], "chunk_id string, text string, domain string, source_id string, block int, site string")
    got = sorted((r["id"], r["line_no"]) for r in S.repeated_lines(df).collect())
    assert got == brute(data) and got


def test_blocks_and_removal(spark):
    df = spark.createDataFrame(site(), "chunk_id string, text string, domain string, source_id string")
    b = S.repeated_lines(df).where("id = 'c3'").orderBy("line_no").collect()
    assert len({r["block"] for r in b}) == 1 and [r["line_no"] for r in b] == [0, 1]
    t = {r["id"]: r for r in S.without_repeated(df).collect()}
    assert "readers" not in t["c3"]["text"] and t["c3"]["n_removed"] == 2 and t["c1"]["n_removed"] == 0 and t["c1"]["text"] == dict((r[0], r[1]) for r in site())["c1"]
    assert len(t) == 80


def test_edges_settle_the_blocks(spark):
    """Two lines far from each other are two blocks; only letterless lines between them make them one, a lettered one does not."""
    rows = lambda mid: [(f"c{i}", f"Share this\n{mid(i)}All rights reserved\nbody {chr(97 + i)}", "s", f"p{i}") for i in range(12)]
    cols = "chunk_id string, text string, domain string, source_id string"
    blocks = lambda mid: S.block_report(spark.createDataFrame(rows(mid), cols)).count()
    assert blocks(lambda i: "") == 1 and blocks(lambda i: "***\n\n42\n---\n") == 1
    assert blocks(lambda i: f"own {chr(97 + i)}\n") == 2
    got = S.without_repeated(spark.createDataFrame(rows(lambda i: f"own {chr(97 + i)}\n"), cols)).collect()
    assert {(r["n_removed"], r["n_blocks"]) for r in got} == {(2, 2)}


def test_empty(spark):
    df = spark.createDataFrame([], "chunk_id string, text string, domain string, source_id string")
    assert S.repeated_lines(df).count() == 0 and S.without_repeated(df).count() == 0

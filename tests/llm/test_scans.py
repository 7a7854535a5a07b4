from pyspark.sql import functions as F

from corpuskiln.llm import scans as S

BODY = "The lord of the second house touches every star beyond the\nteacher and every useful crescent answers the moon in the old\nhouse of the village and the harvest of the season is near the\nriver."


def test_furniture_forms():
    assert S.furniture(f"The tenth house\n\n{BODY}", "The Book of X", "The tenth house") == []
    lines = BODY.split("\n")
    for extra in ("12", "- 8 -", "[7]", "p. 2", "xvii", "THE BOOK OF X", "T H E   B O O K", "8   The Book of X", "The Book of X", "  NOTES ON MARS        3"):
        text = "\n".join([*lines[:2], extra, *lines[2:]])
        assert S.furniture(text, "The Book of X", "Notes on Mars") == [2], extra
    assert S.furniture("and it was in the year of the great and famous eclipse\n1858.", "T", None) == []
    assert S.furniture("", None, None) == [] and S.furniture("| a |\n| 1 |", None, None) == []
    assert S.furniture("Das 19. Haus\n\nText ist hier.", "Das Buch X", "Das 19. Haus") == []


def test_unwrapped():
    text, breaks = S.unwrapped("every ind¬\nependent lord and rem-\n12\narkable sign\n\nNew part here", [2])
    assert text == "every independent lord and remarkable sign\n\nNew part here" and [b[0] for b in breaks] == ["independent", "remarkable"]
    assert S.unwrapped("a well -\nKnown", [])[1] == []


def test_inline_title():
    line = "the harvest of nœuds L E   L I V R E   D E   X lunaires"
    assert [line[a:b] for a, b in S.inline(line, None)] == ["L E   L I V R E   D E   X"]


def noisy(n=60):
    good = ["the remarkable harvest of the independent village resembles the constitution", "every favourable interpretation determines the particular inheritance"]
    return [(f"g{i}", good[i % 2]) for i in range(n)]


def test_found_and_repaired(spark):
    corpus = spark.createDataFrame([(t,) for _, t in noisy()], "text string")
    bad = "the rernarkable harvest of the inclependent village resernbles the c0nstitution"
    units = spark.createDataFrame(
        [("chunk", "a", None, None, bad), ("chunk", "b", "The Book of X", None, "the harvest of the inde-\npendent village is near the\n12\nold river of the village"), ("block", "1", None, None, "the remarkable harvest of the village"), ("chunk", "n", None, None, None), ("chunk", "e", None, None, ""), ("chunk", "a", None, None, bad)],
        "record_type string, record_id string, title string, heading string, text string",
    )
    got = sorted(tuple(r) for r in S.found(units, corpus).collect())
    assert got == [("chunk", "a", "misread"), ("chunk", "b", "hyphen_break"), ("chunk", "b", "page_furniture")]
    r = {(x["record_type"], x["record_id"]): x for x in S.repaired(units, corpus).collect()}
    assert r[("chunk", "a")]["text"] == noisy()[0][1] and r[("chunk", "a")]["n_corrected"] == 4
    assert r[("chunk", "b")]["text"] == "the harvest of the independent village is near the old river of the village" and r[("chunk", "e")]["text"] == ""
    assert S.found(units.limit(0), corpus).count() == 0 and S.found(units, corpus.limit(0)).where("noise = 'misread'").count() == 0


def test_corrections_against_brute_force(spark):
    words = ["harvest", "remarkable", "independent", "village", "constitution", "moon", "window"]
    made = {}
    for w in words:
        for good, bad in S.CONFUSIONS:
            at = w.find(good)
            if at >= 0:
                made.setdefault(w[:at] + bad + w[at + len(good) :], w)
    counts = spark.createDataFrame([(w, 100) for w in words] + [(m, 1) for m in made if m not in words], "word string, n long")
    got = {r["word"]: r["correct"] for r in S.corrections(counts.select("word"), counts).collect()}
    assert got == {m: w for m, w in made.items() if m not in words}
    none = counts.where(F.lit(False))
    assert S.corrections(none.select("word"), none).count() == 0


def test_counts_whole_texts(spark):
    df = spark.createDataFrame([("a b a, B.",), (None,), ("a " * 50_000,)], "text string")
    assert {r["word"]: r["n"] for r in S.word_counts(df).collect()} == {"a": 50_002, "b": 2}

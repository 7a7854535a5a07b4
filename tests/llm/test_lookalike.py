import collections
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from corpuskiln.llm import lookalike as L


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


FORMS = ["fi na", "ﬁ na", "ﬁ na", "fі nа", "f​i na", "ｆｉ na", "fi  na"]


def test_classes(spark):
    texts = [*FORMS, "Fi na", "fí na", "fí na", "fi\nna", "5 a", "५ a", "５ a", "", "", None, "x" * 200_000]
    df = spark.createDataFrame([(f"{i:02d}", t, "clash") for i, t in enumerate(texts)], "chunk_id string, text string, id string")
    m = {r["id"]: r for r in L.canonical_members(df).collect()}
    assert {m[f"{i:02d}"]["canonical_id"] for i in range(7)} == {"00"} and m["00"]["class_size"] == 7
    assert m["07"]["class_size"] == 1 and m["10"]["class_size"] == 1
    assert m["08"]["canonical_id"] == m["09"]["canonical_id"] and m["08"]["n_forms"] == 2
    assert m["11"]["canonical_id"] == m["13"]["canonical_id"] != m["12"]["canonical_id"]
    assert m["14"]["class_size"] == 2 and m["14"]["n_forms"] == 1 and "16" not in m
    out = {r["id"]: r["text"] for r in L.canonical_text(df).collect()}
    assert {out[f"{i:02d}"] for i in range(7)} == {"fi na"} and out["12"] == "५ a" and out["14"] == "" and "16" not in out and len(out) == len(m)


def test_canonical_member_is_the_plain_one(spark):
    # the smallest id and the majority are disguised; a text without a twin is brought to the common form, too
    df = spark.createDataFrame([("0", "fі na"), ("1", "fі na"), ("2", "fi na"), ("3", "fi\u0001 na"), ("4", "ѕo lonely"), ("5", "𝐁𝐨𝐥𝐝 Ⅷ")], "chunk_id string, text string")
    assert {r["canonical_id"] for r in L.canonical_members(df).collect() if r["id"] < "4"} == {"2"}
    out = {r["id"]: r["text"] for r in L.canonical_text(df).collect()}
    assert len({out[k] for k in "0123"}) == 1 and out["4"] == "so lonely" and out["5"] == "Bold VIII"


def test_plain_texts_need_no_mapping(spark):
    texts = ["plain ascii", "Ünïcode é “x” – y…", "नमस्ते दुनिया", "a  b", "a \nb", " a", "a ", "a\tb", "क़", "न\u093c", "ĳ", "a\u00adb"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", L._doubtful(L.F.col("text")).alias("d")).collect()
    assert [r["i"] for r in sorted(got) if r["d"] is None] == [0, 1, 2]
    assert all(L.map_look(texts[i]) == texts[i] for i in range(3))


def test_pairs_against_brute_force(spark):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate([*FORMS, "other", "оther", "fi na"])] + [("0", "fi na")], "chunk_id string, text string")
    data = dict(df.collect())
    want = sorted((a, b) for a in data for b in data if a < b and data[a] != data[b] and unicodedata.normalize("NFKC", L.map_look(data[a])) == unicodedata.normalize("NFKC", L.map_look(data[b])))
    assert rows(L.look_pairs(df), "id_a", "id_b") == want


def test_what_only_the_collation_equates(spark):
    forms = ["fi na", "fi\u0001 na", "f\u009fi na"]
    assert len({L.map_look(t) for t in forms}) == 3
    df = spark.createDataFrame(list(zip("0123", [*forms, "fí na"])), "chunk_id string, text string")
    assert rows(L.look_pairs(df), "id_a", "id_b") == [("0", "1"), ("0", "2"), ("1", "2")]
    assert sorted(r["class_size"] for r in L.canonical_members(df).collect()) == [1, 3, 3, 3]


def test_empty_table(spark):
    df = spark.createDataFrame([], "chunk_id string, text string")
    assert L.look_pairs(df).count() == 0 and L.canonical_members(df).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_mapping_is_stable(text):
    once = L.map_look(text)
    assert L.map_look(once) == once


def test_mapping_keeps_what_a_reader_sees():
    assert L.map_look("Ünïcode Ñandú 123") == "Ünïcode Ñandú 123"
    assert L.map_look("a-­\nb") == "a--\nb"
    assert collections.Counter(map(L.map_look, ["a", "A", "á", "à", "1", "l"])).most_common(1)[0][1] == 1

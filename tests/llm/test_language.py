import pytest

from corpuskiln.llm import language as L

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def samples(spark):
    return spark.read.parquet(f"{DATA}/lang_samples.parquet")


def test_held_out_accuracy(samples):
    rows = [(r["lang"], r["text"]) for r in samples.orderBy("sample_id").collect()]
    names, protos = L.fit(rows[::2])
    run = L._tagger(names, protos)
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(rows[1::2]))]), pa.array([r[0] for r in rows[1::2]]), pa.array([r[1] for r in rows[1::2]])], names=["id", "label", "text"])
    out = [r for x in run(iter([b])) for r in x.to_pylist()]
    right = sum(r["lang"] == r["label"] for r in out)
    assert right >= 0.97 * len(out)


def test_found_and_segments(spark, samples):
    by = {r["lang"]: r["text"] for r in samples.orderBy("sample_id").collect()}
    en, de = "The Moon moderates the mirror of the navamsa under this season of the hypothesis.", "Der Kalender unterbricht den günstigen Tag, wenn Jupiter nicht widerspricht."
    rows = [
        ("a", f"{en} {en}", "en"), ("b", f"{en} {en}", "de"), ("c", f"{en} {en}", None), ("d", f"{en} {en}", "en_US"), ("e", f"{en}\n\n{de} {de}", "en"),
        ("f", "Heading only", "xx"), ("g", "", "xx"), ("h", None, None), ("i", f'{en} He says "{de}" (see there).', "English"), ("b", f"{en} {en}", "de"), ("j", by["hi"], "HI"),
        ("k", en + " " + en * 3000, "unknown"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "chunk_id string, text string, lang string, label string")
    got = sorted((r["id"], r["lang"]) for r in L.wrong_labels(df, samples).collect())
    assert got == [("b", "en"), ("c", "en"), ("e", "de"), ("e", "en"), ("k", "en")]
    s = sorted((r["seg_no"], r["lang"]) for r in L.segments(df.where("chunk_id = 'e'"), samples).collect())
    assert s == [(0, "en"), (1, "de")]
    assert all(0 < r["confidence"] <= 1 for r in L.segments(df, samples).collect())


def test_text_without_full_stop(spark, samples):
    rows = [
        ("a", "This is fine and good as it stands here. Und dann kam der lange Satz über die Tafel der Häuser ganz ohne Punkt", "en"),
        ("b", "Und dann kam der lange Satz über die Tafel der Häuser ganz ohne Punkt", None),
        ("c", 'The rule holds for the moon and the sun. "' + "Der Schüler liest die Tafel der Häuser und schreibt, " * 30 + 'er lernt" is what he wrote here.', "en"),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, text string, lang string")
    seg = {}
    for r in L.segments(df, samples).orderBy("id", "seg_no").collect():
        seg.setdefault(r["id"], []).append(r["lang"])
    assert seg == {"a": ["en", "de"], "b": ["de"], "c": ["en"]}
    assert L.wrong_labels(df, samples).count() == 0


def test_a_seventh_language(spark, samples):
    pt = ["A lua está na nona casa e não ajuda o senhor do ascendente.", "O livro diz que as casas são contadas depois do nascer do sol.", "Não há nenhuma regra que não tenha sido escrita pelos mestres."]
    more = samples.union(spark.createDataFrame([(1000 + i, "pt", t) for i, t in enumerate(pt * 3)], samples.schema))
    df = spark.createDataFrame([("a", " ".join(pt), "pt"), ("b", " ".join(pt), "en")], "chunk_id string, text string, lang string")
    assert [tuple(r) for r in L.wrong_labels(df, more).collect()] == [("b", "pt")]


def test_empty(spark, samples):
    df = spark.createDataFrame([("a", "Some text is here.", "en")], "chunk_id string, text string, lang string")
    assert L.wrong_labels(df.limit(0), samples).count() == 0
    assert L.wrong_labels(df, samples.limit(0)).count() == 0


def test_labels(spark):
    from pyspark.sql import functions as F

    want = {"en": "en", "EN": "en", "en-GB": "en", "en_US": "en", "English": "en", "deu": "de", "xx": None, "": None, "ca": None, "hi-IN": "hi", None: None, "und": None}
    df = spark.createDataFrame([(k,) for k in want], "l string").select("l", L.label_of(F.col("l")).alias("c"))
    assert {r["l"]: r["c"] for r in df.collect()} == want

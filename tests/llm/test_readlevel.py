from corpuskiln.llm import readlevel as R

DATA = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    rows = [(r["level"], r["text"]) for r in spark.read.parquet(f"{DATA}/level_samples.parquet").orderBy("sample_id").collect()]
    right = 0
    for fold in range(4):
        m = R.Reader([r for i, r in enumerate(rows) if i // 4 % 4 != fold])
        right += sum(m.level(t) == v for i, (v, t) in enumerate(rows) if i // 4 % 4 == fold)
    assert right >= 0.95 * len(rows)


def test_levels(spark):
    samples = spark.read.parquet(f"{DATA}/level_samples.parquet")
    s = samples.orderBy("sample_id").collect()
    rows = [(i, r["text"]) for i, r in enumerate(s)] + [(0, s[0]["text"]), (900, ""), (901, None), (902, "zzz qqq"), (903, s[0]["text"] * 500), (None, "x")]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, level int, id string")
    got = {r["id"]: r["level"] for r in R.reading_levels(df, samples).collect()}
    assert sum(got[i] == r["level"] for i, r in enumerate(s)) >= 0.98 * len(s)
    assert got[900] is None and got[901] is None and got[902] == 1 and got[903] == got[0] and None not in got
    assert R.reading_levels(df.limit(0), samples).count() == 0
    assert {r["level"] for r in R.reading_levels(df, samples.limit(0)).collect()} == {None}

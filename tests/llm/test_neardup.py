import random

import pytest

from corpuskiln.llm import neardup as N


def brute(data, shingle=1, num=4, den=5):
    sets = {i: N.words_of(t, shingle) for i, t in data.items() if t}
    ids = sorted(i for i in sets if sets[i])
    out = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x = len(sets[a] & sets[b])
            if x * den >= num * len(sets[a] | sets[b]):
                out.append((a, b))
    return sorted(out)


def corpus(n, seed, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    data, texts = {}, []
    for i in range(n):
        if texts and rng.random() < 0.6:
            t = rng.choice(texts).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 6])):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice([[], [rng.choice(words)], [t[k], rng.choice(words)]]) or t[k : k + 1][:0]
                t = t or ["w0"]
            rng.random() < 0.2 and rng.shuffle(t)
        else:
            t = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 8, 20, 45, 120]))]
        texts.append(" ".join(t))
        data[f"d{i:04d}"] = texts[-1]
    return data


@pytest.mark.parametrize("seed, kw", [(1, {}), (2, {}), (3, {"shingle": 5}), (4, {"num": 9, "den": 10})])
def test_pairs_against_brute_force(spark, seed, kw):
    data = corpus(260, seed)
    df = spark.createDataFrame(list(data.items()), "chunk_id string, text string")
    got = sorted(tuple(r) for r in N.near_pairs(df, **kw).collect())
    assert got == brute(data, **kw) and got


def test_hot_keys_and_many_partitions(spark, monkeypatch):
    data = corpus(260, 5)
    df = spark.createDataFrame(list(data.items()), "chunk_id string, text string")
    monkeypatch.setattr(N, "HOT", 3)
    monkeypatch.setattr(N, "SEEN", 10)
    monkeypatch.setattr(N, "by_volume", lambda d, rows, *k: d.repartition(9, *k))
    assert sorted(tuple(r) for r in N.near_pairs(df).collect()) == brute(data)


def test_many_copies_and_variants(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(f"a{i:05d}", " ".join(base)) for i in range(10_000)] + [(f"b{i:03d}", " ".join([*base[:39], f"x{i}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "chunk_id string, text string").repartition(4)
    g = N.near_groups(df)
    got = {tuple(r) for r in g.groupBy(g.id.substr(1, 1).alias("k"), "class_id", "n_copies", "n_links").count().collect()}
    assert got == {("a", "a00000", 10_000, 300, 10_000), ("b", "a00000", 1, 300, 300)}


def test_edges(spark):
    rows = [("a", "One two  three"), ("b", "three ONE two"), ("c", None), ("d", ""), ("e", "   "), ("a", "One two  three"), ("f", "ｏne two three"), ("g", "long " * 30_000), ("h", "solo")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "chunk_id string, text string, n int, sig string")
    assert sorted(tuple(r) for r in N.near_pairs(df).collect()) == [("a", "b"), ("a", "f"), ("b", "f")]
    g = {r["id"]: r for r in N.near_groups(df).collect()}
    assert set(g) == {"a", "b", "f", "g", "h"} and g["f"]["class_id"] == "a" and g["a"]["n_copies"] == 3 and g["h"]["n_links"] == 0
    empty = df.limit(0)
    assert N.near_pairs(empty).count() == 0 and N.near_groups(empty).count() == 0


def test_groups_are_components(spark):
    base = [f"w{i}" for i in range(30)]
    chain = [" ".join(base[:30]), " ".join([*base[:27], "x", "y", "z"]), " ".join([*base[:24], "x", "y", "z", "p", "q", "r"])]
    df = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(chain)] + [("z", "alone")], "chunk_id string, text string")
    g = {r["id"]: r for r in N.near_groups(df).collect()}
    assert {g[f"c{i}"]["class_id"] for i in range(3)} == {"c0"} and [g[f"c{i}"]["n_links"] for i in range(3)] == [1, 2, 1] and g["z"]["class_id"] == "z"


def test_threshold_is_exact():
    t = N.Threshold(4, 5)
    for a in range(1, 60):
        for b in range(a, 60):
            for x in range(a + 1):
                assert (x >= t.overlap(a + b)) == (5 * x >= 4 * (a + b - x))

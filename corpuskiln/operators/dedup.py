"""Exact and near duplicates of chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import broadcast_if_small, discard, settle, ship


def text_key(text: Column) -> Column:
    return F.md5(X.py_strip(text))


def keep_first(chunks: DataFrame, order: list[str], within: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Of children with equal stripped text (in a source, if given) the first in order; parents are all kept.

    The first is found by a partial aggregation, so a text that a third of the rows share is not gathered anywhere.
    """
    c = chunks.withColumn("__key", text_key(F.col(text_col)))
    children = c.where(~F.coalesce("is_parent", F.lit(False)))
    key = [*(within or []), "__key"]
    first = children.groupBy(*key).agg(F.min(F.struct(*order)).alias("__first"))
    kept = children.join(first, key).where(F.struct(*order) == F.col("__first")).drop("__first")
    return c.where(F.coalesce("is_parent", F.lit(False))).unionByName(kept).drop("__key")


def band_hashes(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash for each band of ``rows`` minima over seeded scrambles of a set's 64-bit hashes."""
    seeds = np.random.default_rng(20).integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    x = hashes.view(np.uint64)[None, :] ^ seeds[:, None]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    low = (x ^ (x >> np.uint64(31))).min(axis=1).reshape(bands, rows)
    weights = np.random.default_rng(21).integers(0, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
    return (low * weights[None, :]).sum(axis=1, dtype=np.uint64).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """64 bits of a set: bit i is the parity of the number of its hashes that fall on i. Two sets differ in one word at least for each bit
    in which these differ."""
    n = np.bincount((hashes.view(np.uint64) >> np.uint64(58)).astype(np.int64), minlength=64) & 1
    return np.packbits(n.astype(np.uint8), bitorder="little").view(np.int64)


def minhash(tokens: Column, bands: int, rows: int) -> Column:
    """Parities and then band hashes of a set of words; only the words' hashes go through Arrow."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def signature(sets: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate([parities(h), band_hashes(h, bands, rows)]) if h is not None else None for h in (np.array(s, dtype=np.int64) if s is not None and len(s) else None for s in sets)], dtype=object)

    return signature(F.transform(tokens, lambda w: F.xxhash64(w)))


def near_links(chunks: DataFrame, threshold: float = 0.9, bands: int = 21, rows: int = 6, order: list[str] | None = None) -> DataFrame:
    """``a, b`` (a before b in order) of word sets that share a band and have Jaccard >= threshold. Equal sets collapse first.

    With 21 bands of 6 a pair at the threshold of 0.9 is missed once in 7 million; the links found are verified exactly.
    """
    order = order or ["chunk_id"]
    return _links(chunks, word_sets(chunks, order, bands, rows), order, threshold, bands)


def _words() -> Column:
    return F.array_sort(F.array_distinct(X.blank_words(F.col("text"))))


def word_sets(chunks: DataFrame, order: list[str], bands: int = 21, rows: int = 6) -> DataFrame:
    """``o, h, n, sig`` of every text with words: its place, hash and number of its words, parities and band hashes; written once, without the words."""
    ship(chunks.sparkSession)
    t = chunks.select(F.struct(*order).alias("o"), _words().alias("w")).where(F.size("w") > 0)
    return settle(t.select("o", F.xxhash64("w").alias("h"), F.size("w").alias("n"), minhash(F.col("w"), bands, rows).alias("sig")), "minhash", clean=True)


#: Bands that are shuffled at once: the keys of the others need no disk meanwhile.
AT_ONCE = 7


def _links(chunks: DataFrame, sets: DataFrame, order: list[str], threshold: float, bands: int = 21) -> DataFrame:
    """Only the words of candidates are read again; copies meet as one hash. Most texts that share a band are not near: they are told by their
    sizes and parities inside the join. The words of sets of n and m that are near differ by (n + m)(1 - t) / (1 + t) at most, so no link is lost."""
    differ = F.greatest(F.bit_count(F.col("x.p").bitwiseXOR(F.col("y.p"))), F.abs(F.col("x.n") - F.col("y.n")))
    near = differ <= (F.col("x.n") + F.col("y.n")) * (1 - threshold) / (1 + threshold) + 1e-6
    found = None
    for lo in range(0, bands, AT_ONCE):
        part = sets.select("h", "n", F.element_at("sig", 1).alias("p"), F.slice("sig", lo + 2, AT_ONCE).alias("v"))
        keys = part.groupBy("h").agg(*[F.first(c).alias(c) for c in ("n", "p", "v")]).select("h", "n", "p", F.explode("v").alias("v"))
        met = keys.alias("x").join(keys.alias("y"), (F.col("x.v") == F.col("y.v")) & (F.col("x.h") < F.col("y.h")) & near)
        met = settle(met.select(F.col("x.h").alias("ha"), F.col("y.h").alias("hb")).distinct(), "minhash-met", clean=True)
        found = met if found is None else found.union(met)
    pairs = settle(found.distinct(), "minhash-pairs", clean=True)
    needed = settle(pairs.select(F.col("ha").alias("h")).union(pairs.select("hb")).distinct(), "minhash-needed")
    places = settle(sets.join(broadcast_if_small(needed, 40), "h", "left_semi").groupBy("h").agg(F.min("o").alias("o")), "minhash-places", clean=True)
    # a place may be that of several texts; the hash tells which is meant (as no key of the join, for which all texts would be split)
    again = chunks.select(F.struct(*order).alias("o"), "text").join(broadcast_if_small(places, 200), "o").select("h", "o", _words().alias("w"))
    words = settle(again.where(F.xxhash64("w").bitwiseXOR(F.col("h")) == 0).dropDuplicates(["h"]), "minhash-words", clean=True)
    a, b = words.toDF("ha", "oa", "wa"), words.toDF("hb", "ob", "wb")
    both = pairs.join(a, "ha").join(b, "hb")
    same = F.size(F.array_intersect("wa", "wb"))
    return both.where(same / (F.size("wa") + F.size("wb") - same) >= threshold).select(F.least("oa", "ob").alias("a"), F.greatest("oa", "ob").alias("b"))


def keep_greedy(links: DataFrame) -> DataFrame:
    """``b`` of the rows that a greedy pass in order drops: a row goes if a kept earlier one is linked with it.

    Rounds settle it without a pass over all rows: a row with no undecided earlier neighbour is kept, its later neighbours go.
    """
    open_ = settle(links.select("a", "b").distinct(), "greedy")
    dropped = None
    while True:
        kept = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = settle(open_.join(kept, "a", "left_semi").select("b").distinct(), "greedy-gone")
        dropped = gone if dropped is None else dropped.union(gone)
        rest = open_.join(kept, "a", "left_anti").join(gone, "b", "left_anti").join(gone.select(F.col("b").alias("a")), "a", "left_anti")
        last, open_ = open_, settle(rest.select("a", "b"), "greedy")
        discard(last)
        if open_.isEmpty():  # every round settles the first undecided row at least
            return dropped


def near_dedup(chunks: DataFrame, threshold: float = 0.9, order: list[str] | None = None) -> DataFrame:
    """Children without exact copies and without those that are near an earlier kept one; parents come along. Rows without a word go."""
    order = order or ["chunk_id"]
    parents = chunks.where(F.coalesce("is_parent", F.lit(False)))
    own = chunks.where(~F.coalesce("is_parent", F.lit(False)))
    sets = word_sets(own, order)
    gone = keep_greedy(_links(own, sets, order, threshold))
    kept = sets.groupBy("h").agg(F.min("o").alias("o")).join(gone.select(F.col("b").alias("o")), "o", "left_anti")
    return parents.unionByName(own.join(kept.select("o.*"), order, "left_semi").select(*chunks.columns))

"""Problem 1: near-duplicate texts as an exact set-similarity join.

Method: grouped prefix join. A text is its set of distinct lower-case blank-separated words (or word
shingles). Two sets of sizes x and y with Jaccard >= t differ in at most H(x, y) words. The prefix is
taken not over single words but over parts of the set: words fall by hash into m > H parts, so at
least m - H parts are equal, and with the parts of a text ordered by rarity (frequent words estimated
from all documents) the first H + 1 parts of two similar texts have one in common. A prefix of single
words is exact, too, but on texts from a small vocabulary its posting lists join nearly everything
with everything (168 million pairs at 38 thousand texts, parts: 5 million).

Texts of identical prefix, size and bitmap collapse to one group; groups meet on a part of the
prefix, are filtered by size and by the distance of their 128-bit parity bitmaps (never larger than
the distance of the sets), then expanded to their different word sets, which are verified exactly.

Sizes fall into bands; a text also emits keys for the next band when a larger partner may lie there.
All counts are over all documents, nothing is capped. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, by_volume, discard, settle, ship
from .lookalike import map_look

#: Ratio of the bounds of a size band.
BAND = 1.4
#: Parts of a text per emitted part.
SPARE = 1.1
#: Words that at least this share of the documents hold are counted for the order of parts; at most FREQUENT of them.
FREQUENT_SHARE, FREQUENT = 0.001, 65536
#: Groups a task remembers, so as not to emit their keys again.
SEEN = 500_000
#: A key with more groups than this is hot: its groups are dealt out by a salt.
HOT = 2_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Threshold:
    """Jaccard >= num / den in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, total):
        """Least number of common words of two sets with ``total`` words together."""
        return -(-self.num * total // (self.num + self.den))

    def distance(self, total: np.ndarray) -> np.ndarray:
        """Most different words over all pairs with up to ``total`` words together."""
        t = np.asarray(total)
        return np.maximum(t - 2 * self.overlap(t), (t - 1) - 2 * self.overlap(np.maximum(t - 1, 0)))

    def largest(self, n):
        """Largest partner of a set of n words."""
        return n * self.den // self.num


def bands(limit: int = 1 << 40) -> np.ndarray:
    e = [1]
    while e[-1] < limit:
        e.append(max(e[-1] + 1, int(e[-1] * BAND) + 1))
    return np.array(e, dtype=np.int64)


EDGES = bands()


def words_of(text: str, shingle: int) -> set[str]:
    """Distinct lower-case words of a text as it reads; with shingle > 1, runs of so many words (a shorter text is one run)."""
    w = unicodedata.normalize("NFKC", map_look(text)).lower().split()
    if shingle > 1:
        return {" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()
    return set(w)


class Hasher:
    """64-bit hashes of words; keeps those of up to a million words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: set[str]) -> list[int]:
        known, out = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                if len(known) > 1_000_000:
                    known.clear()
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return out


def _sets(batch: pa.RecordBatch, hasher: Hasher, shingle: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Ids, sizes and the flat word hashes of a batch's texts that have words."""
    ids, sizes, flat = [], [], []
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        h = hasher(words_of(t, shingle)) if t else ()
        if h:
            ids.append(i)
            sizes.append(len(h))
            flat.extend(h)
    return ids, np.array(sizes, dtype=np.int64), np.array(flat, dtype=np.uint64)


def _counter(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, parts, held = Hasher(), [], 0

        def flush():
            word, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

        for b in batches:
            _, _, flat = _sets(b, hasher, shingle)
            parts.append(flat)
            held += len(flat)
            if held > 4_000_000:
                yield flush()
                parts, held = [], 0
        if held:
            yield flush()

    return run


def _emitter(shingle: int, t: Threshold, freq: np.ndarray, weight: np.ndarray, absent: np.ndarray, rare: int):
    """Rows of kind 0: a document with its group and word set; of kind 1: a group's key. Of a group's members in one task the first emits its keys."""

    def base(m: int) -> np.ndarray:
        b = np.zeros(m, dtype=np.int64)
        np.add.at(b, (freq % _U(m)).astype(np.int64), absent)
        return b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bases, seen = Hasher(), {}, set()
        names = ["kind", "id", "key", "grp", "sig", "n", "b1", "b2"]

        def rows(kind, ids, key, grp, sig, n, b1, b2):
            i64 = lambda x: pa.array(x.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, dtype=np.int8)), ids, i64(key), i64(grp), i64(sig), pa.array(n.astype(np.int32)), i64(b1), i64(b2)], names=names)

        for batch in batches:
            ids, size, flat = _sets(batch, hasher, shingle)
            if not ids:
                continue
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            mixed = _mix(flat)
            sig = np.add.reduceat(mixed, start)
            at = np.searchsorted(freq, flat) if len(freq) else np.zeros(len(flat), dtype=np.int64)
            at = np.minimum(at, max(0, len(freq) - 1))
            logit = np.where(freq[at] == flat, weight[at], rare) if len(freq) else np.full(len(flat), rare)
            bits = np.zeros((len(ids), 2), dtype=np.uint64)
            doc = np.repeat(np.arange(len(ids)), size)
            np.bitwise_xor.at(bits, (doc, ((mixed >> _U(8)) & _U(1)).astype(np.int64)), _U(1) << (mixed & _U(63)))
            band = np.searchsorted(EDGES, size, side="right") - 1
            most = t.largest(size)
            grp = np.zeros(len(ids), dtype=np.uint64)
            out = []
            for up in (0, 1):
                for level in np.unique(band + up):
                    own = np.flatnonzero((band + up == level) & (most >= EDGES[level]))
                    if not len(own):
                        continue
                    hi = EDGES[level + 1] - 1
                    m = max(1, int(SPARE * (int(t.distance(2 * hi)) + 1)))
                    prefix = np.minimum(t.distance(size[own] + np.minimum(most[own], hi)) + 1, m)
                    row = np.full(len(ids), -1, dtype=np.int64)
                    row[own] = np.arange(len(own))
                    r = row[doc]
                    use = r >= 0
                    r, part = r[use], (flat[use] % _U(m)).astype(np.int64)
                    content = np.zeros((len(own), m), dtype=np.uint64)
                    np.add.at(content, (r, part), mixed[use])
                    if m not in bases:
                        bases[m] = base(m)
                    score = np.repeat(bases[m][None, :], len(own), axis=0)
                    np.add.at(score, (r, part), logit[use])
                    key = _mix(content ^ _mix(np.arange(m, dtype=np.uint64) + _U(int(level) << 32))[None, :])
                    # whole numbers make the order the same for every text: rarity, then the key
                    order = np.argsort((score << 24) | (key >> _U(40)).astype(np.int64), axis=1, kind="stable")[:, : int(prefix.max())]
                    keep = np.arange(order.shape[1])[None, :] < prefix[:, None]
                    chosen = np.take_along_axis(key, order, axis=1)
                    # the prefix for the next band counts, too: members of a group emit the same keys
                    g = np.where(keep, _mix(chosen), _U(0)).sum(axis=1, dtype=np.uint64)
                    grp[own] ^= _mix(g + _U(up)) if up else _mix(g + size[own].astype(np.uint64)) ^ _mix(bits[own, 0] + _U(1)) ^ _mix(bits[own, 1] + _U(2))
                    out.append((up, own, chosen, keep))
            yield rows(0, pa.array(ids, pa.string()), sig, grp, sig, size, sig, sig)
            if len(seen) > SEEN:  # a group whose keys are emitted again changes nothing
                seen.clear()
            fresh = np.zeros(len(ids), dtype=bool)
            for i, g in enumerate(grp.tolist()):
                if g not in seen:
                    seen.add(g)
                    fresh[i] = True
            for up, own, chosen, keep in out:
                keep = keep & fresh[own][:, None]
                r, _ = np.nonzero(keep)
                d = own[r]
                yield rows(1, pa.nulls(len(d), pa.string()), chosen[keep], grp[d], sig[d], size[d] * 2 + up, bits[d, 0], bits[d, 1])

    return run


def near_links(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", shingle: int = 1, num: int = 4, den: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: members ``id, sig, n`` with the word set of every document, links ``sig_a < sig_b`` between
    different word sets with Jaccard >= num / den.

    Null and blank texts have no words and get no row. A repeated id counts once (with several texts, the smallest
    signature counts). Other columns are ignored. An empty table gives empty results.
    """
    ship(df.sparkSession)
    t = Threshold(num, den)
    texts = df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counts = settle(texts.mapInArrow(_counter(shingle), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "neardup-words")
    total = texts.count()
    # a bounded statistic for the order of parts only: it changes the cost, never the result
    top = counts.where(F.col("n") >= max(2, FREQUENT_SHARE * total)).orderBy(F.desc("n"), "word").limit(FREQUENT).toPandas()
    share = np.minimum(top["n"].to_numpy(dtype=float) / max(1, total), 0.999)
    word = top["word"].to_numpy(dtype=np.int64).view(np.uint64)
    by = np.argsort(word)
    weight = np.round(1000 * (np.log(share) - np.log1p(-share))).astype(np.int64)[by]
    absent = np.round(1000 * np.log1p(-share)).astype(np.int64)[by]
    emitted = settle(
        texts.mapInArrow(_emitter(shingle, t, word[by], weight, absent, int(1000 * np.log(FREQUENT_SHARE / 2))), "kind byte, id string, key bigint, grp bigint, sig bigint, n int, b1 bigint, b2 bigint"),
        "neardup-keys",
    )
    members = settle(emitted.where("kind = 0").groupBy("id").agg(F.min(F.struct("sig", "grp", "n")).alias("m")).select("id", "m.sig", "m.grp", "m.n"), "neardup-members")
    keys = emitted.where("kind = 1").select("key", "grp", "n", "b1", "b2")
    # the left groups of a hot key are dealt out over as many salts as it holds HOT groups, the right ones go to each salt
    hot = settle(keys.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > HOT).select("key", F.ceil(F.col("k") / HOT).cast("int").alias("salts")), "neardup-hot")
    hot = broadcast_if_small(hot, 24)
    na, nb = F.expr("a.n div 2"), F.expr("b.n div 2")
    s = na + nb
    most = s - 2 * F.floor((num * s + (num + den - 1)) / (num + den))
    apart = F.bit_count(F.col("a.b1").bitwiseXOR(F.col("b.b1"))) + F.bit_count(F.col("a.b2").bitwiseXOR(F.col("b.b2")))
    near = (F.col("a.grp") < F.col("b.grp")) & F.expr("(a.n & 1) + (b.n & 1) < 2") & (na * den >= nb * num) & (nb * den >= na * num) & (apart <= most)
    both = [F.col("a.grp").alias("grp_a"), F.col("b.grp").alias("grp_b")]
    cold, salted = by_volume(keys.join(hot, "key", "left_anti"), keys.count(), "key"), keys.join(hot, "key")
    meet = cold.alias("a").join(cold.alias("b"), (F.col("a.key") == F.col("b.key")) & near).select(*both)
    left = salted.withColumn("salt", F.pmod(F.xxhash64("grp"), F.col("salts")).cast("int")).alias("a")
    right = salted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("b")
    crowd = left.join(right, (F.col("a.key") == F.col("b.key")) & (F.col("a.salt") == F.col("b.salt")) & near).select(*both)
    groups = settle(meet.union(crowd).distinct(), "neardup-groups")
    sets = members.groupBy("grp", "sig").agg(F.min("id").alias("id"))
    several = sets.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1").select("grp")
    pairs = settle(
        groups.union(several.select("grp", "grp")).toDF("grp_a", "grp_b")
        .join(sets.select(F.col("grp").alias("grp_a"), F.col("sig").alias("sig_a"), F.col("id").alias("id_a")), "grp_a")
        .join(sets.select(F.col("grp").alias("grp_b"), F.col("sig").alias("sig_b"), F.col("id").alias("id_b")), "grp_b")
        .where("grp_a <> grp_b or sig_a < sig_b").select("sig_a", "sig_b", "id_a", "id_b"),
        "neardup-candidates",
    )
    needed = settle(pairs.select(F.col("id_a").alias("id"), F.col("sig_a").alias("sig")).union(pairs.select("id_b", "sig_b")).distinct(), "neardup-needed")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for x in batches:
            sets_ = [np.array(sorted(hasher(words_of(v, shingle))), dtype=np.uint64).view(np.int64) for v in x.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([sum(_mix(v.view(np.uint64)).tolist()) & (2**64 - 1) for v in sets_], pa.uint64()).cast(pa.int64(), safe=False), pa.array(sets_, pa.list_(pa.int64()))], names=["sig", "real", "words"])

    words = texts.join(broadcast_if_small(needed, 64), "id").select("sig", "id", "text").mapInArrow(hashed, "sig bigint, real bigint, words array<bigint>").where("sig = real").dropDuplicates(["sig"]).select("sig", "words")
    words = settle(words, "neardup-sets")
    both = pairs.select("sig_a", "sig_b").join(words.toDF("sig_a", "wa"), "sig_a").join(words.toDF("sig_b", "wb"), "sig_b")
    shared = F.size(F.array_intersect("wa", "wb"))
    ok = shared * (num + den) >= num * (F.size("wa") + F.size("wb"))
    links = settle(both.where(ok).select(F.least("sig_a", "sig_b").alias("sig_a"), F.greatest("sig_a", "sig_b").alias("sig_b")).distinct(), "neardup-links")
    return members.select("id", "sig", "n"), links


def near_pairs(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", **kw) -> DataFrame:
    """All pairs ``id_a < id_b`` (as strings) of different ids with Jaccard >= num / den, copies with equal words included."""
    members, links = near_links(df, id_col, text_col, **kw)
    m = members.select("id", "sig")
    a, b = m.toDF("ia", "sig_a"), m.toDF("ib", "sig_b")
    several = m.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1").select("sig")
    across = links.join(a, "sig_a").join(b, "sig_b").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
    own = m.join(several, "sig", "left_semi").select("id", "sig")
    within = own.toDF("id_a", "sig").join(own.toDF("id_b", "sig"), "sig").where("id_a < id_b").select("id_a", "id_b")
    return across.union(within)


def near_groups(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per document with words: ``id, class_id`` (smallest id of its connected class) ``, n_copies`` (documents of
    equal words, itself included) and ``n_links`` (different word sets it is linked with)."""
    members, links = near_links(df, id_col, text_col, **kw)
    sym = links.union(links.select("sig_b", "sig_a")).toDF("sig", "other")
    degree = sym.groupBy("sig").agg(F.count("*").alias("n_links"))
    sizes = members.groupBy("sig").agg(F.count("*").alias("n_copies"), F.min("id").alias("first_id"))
    label = settle(sizes.join(sym.select("sig").distinct(), "sig").select("sig", F.col("first_id").alias("label")), "neardup-label")
    if not links.isEmpty():
        while True:  # smallest label over neighbours, then over the label's own document: few rounds, cut each time
            near = sym.join(label.toDF("other", "l"), "other").groupBy("sig").agg(F.min("l").alias("l"))
            step = label.join(near, "sig").select("sig", F.least("label", "l").alias("new"), "label")
            jump = step.groupBy("label").agg(F.min("new").alias("root"))
            last, nxt = label, settle(step.join(jump, "label").select("sig", F.least("new", "root").alias("label"), F.col("label").alias("old")), "neardup-label")
            changed = nxt.where("label <> old").limit(1).count()
            label = nxt.select("sig", "label")
            discard(last)
            label._settled_path = nxt._settled_path
            if not changed:
                break
    classes = sizes.join(label, "sig", "left").join(degree, "sig", "left").select("sig", "n_copies", F.coalesce("label", "first_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.join(classes, "sig").select("id", "class_id", "n_copies", "n_links")

"""Problem 7: documents into sequences of fixed capacity.

Method: best-two-fit. A bin is filled greedily with the largest documents that fit; then its smallest
document is exchanged for two unpacked ones that together fill the widened gap more tightly. A
document is divided only when it is longer than the capacity: into full bins and a rest that is packed
like any document.

Documents meet by a hash of their ids in groups of about GROUP documents, each packed by one task that
sees sizes only; the loss against one packing of all is at most the last bins of the groups.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle, ship

#: Documents of a group on average, and specs that one pass over the groups serves.
GROUP, SPECS = 20_000, 64


class Pool:
    """Unpacked documents by size: the sizes present in order, and the documents of each."""

    def __init__(self, sizes: list[int], ids: list[int]):
        self.docs: dict[int, list[int]] = {}
        for n, i in zip(sizes, ids):
            self.docs.setdefault(n, []).append(i)
        self.sizes = sorted(self.docs)

    def take(self, n: int) -> int:
        d = self.docs[n]
        i = d.pop()
        if not d:
            del self.docs[n]
            del self.sizes[bisect_right(self.sizes, n) - 1]
        return i

    def put(self, n: int, i: int) -> None:
        if n not in self.docs:
            insort(self.sizes, n)
            self.docs[n] = []
        self.docs[n].append(i)

    def largest(self, most: int) -> int:
        k = bisect_right(self.sizes, most)
        return self.sizes[k - 1] if k else 0

    def best_two(self, most: int, over: int) -> tuple[int, int] | None:
        """Sizes of two documents with the largest sum that is at most ``most`` and above ``over``."""
        s, best, pair = self.sizes, over, None
        lo, hi = 0, bisect_right(s, most) - 1
        while lo <= hi:
            t = s[lo] + s[hi]
            if t > most:
                hi -= 1
                continue
            if t > best and (lo < hi or len(self.docs[s[lo]]) > 1):
                best, pair = t, (s[lo], s[hi])
                if best == most:
                    break
            lo += 1
        return pair


def best_two_fit(sizes: list[int], ids: list[int], capacity: int) -> list[list[tuple[int, int]]]:
    """Bins of (id, size); every size is from 1 to the capacity."""
    pool, bins = Pool(sizes, ids), []
    while pool.sizes:
        own: list[tuple[int, int]] = []
        gap = capacity
        while n := pool.largest(gap):
            own.append((pool.take(n), n))
            gap -= n
        if gap and own and pool.sizes:
            i, n = own[-1]  # filled largest first
            pair = pool.best_two(gap + n, n)
            if pair:
                own.pop()
                for x in pair:
                    own.append((pool.take(x), x))
                pool.put(n, i)
        bins.append(own)
    return bins


def pack(sizes: DataFrame, specs: DataFrame, id_col: str = "doc_id", group: int = GROUP) -> DataFrame:
    """``pack_name, bin_id, doc_id, piece_no, n_pieces, n_tokens``: a row for each document, or for each piece of one longer than the capacity.

    ``sizes`` has ``doc_id, n_tokens``; documents without tokens or id are in no bin, repeated ids count once (the largest size).
    ``specs`` has ``pack_name, capacity_tokens``; a capacity below 1 or null packs nothing, of a repeated name the largest capacity
    counts. Ties of size go by id. A task fans its group out over the specs, so no document is copied for each spec; specs are read in
    blocks of SPECS, each one pass over the groups.
    """
    ship(sizes.sparkSession)
    kind = sizes.schema[id_col].dataType.simpleString()
    docs = settle(sizes.where(F.col(id_col).isNotNull() & (F.col("n_tokens") > 0)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max("n_tokens").alias("n_tokens")), "pack-sizes")
    groups = max(1, -(-docs.count() // group))
    want = specs.where("capacity_tokens >= 1 and pack_name is not null").groupBy("pack_name").agg(F.max(F.col("capacity_tokens").cast("bigint")).alias("capacity"))
    jobs = docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    schema = f"pack_name string, bin_id bigint, doc_id {kind}, piece_no int, n_pieces int, n_tokens bigint"
    out, block = None, []
    for r in [*want.toLocalIterator(), None]:
        if r is not None:
            block.append((r["pack_name"], r["capacity"]))
        if len(block) == SPECS or r is None and (block or out is None):
            one = jobs.groupBy("part").applyInPandas(_packer(block), schema)
            out, block = one if out is None else out.union(one), []
    return out


def _packer(specs: list[tuple[str, int]]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[True, False])
        ids, sizes, part = pdf["doc_id"].tolist(), pdf["n_tokens"].tolist(), int(pdf["part"].iloc[0])
        names = ["bin_id", "doc_id", "piece_no", "n_pieces", "n_tokens"]
        frames = []
        for name, capacity in specs:
            rows = [(part << 32 | b, ids[k], piece, pieces, n) for b, k, piece, pieces, n in pieces_in_bins(sizes, capacity)]
            frames.append(pd.DataFrame(rows, columns=names).assign(pack_name=name))
        return pd.concat(frames)[["pack_name", *names]] if frames else pd.DataFrame(columns=["pack_name", *names])

    return run


def pieces_in_bins(sizes: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(bin, document, piece, pieces, tokens) of one group: full bins of documents longer than the capacity, then their rests and all others by best-two-fit."""
    out, rests, whose, bin_no = [], [], [], 0
    for k, n in enumerate(sizes):
        full, rest = divmod(n, capacity) if n > capacity else (0, n)
        for piece in range(full):
            out.append((bin_no, k, piece, full + bool(rest), capacity))
            bin_no += 1
        if rest:
            rests.append(rest)
            whose.append(k)
    for own in best_two_fit(rests, whose, capacity):
        for k, n in own:
            pieces = -(-sizes[k] // capacity)
            out.append((bin_no, k, pieces - 1, pieces, n))
        bin_no += 1
    return out


def divided(packed: DataFrame) -> DataFrame:
    """``pack_name, doc_id`` of the documents that lie in several bins."""
    return packed.groupBy("pack_name", "doc_id").agg(F.count_distinct("bin_id").alias("n")).where("n > 1").select("pack_name", "doc_id")


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """``pack_name, capacity_tokens, n_bins, n_tokens, unused_share``: how much room the packing leaves."""
    bins = packed.groupBy("pack_name").agg(F.count_distinct("bin_id").alias("n_bins"), F.sum("n_tokens").alias("n_tokens"))
    return bins.join(specs.groupBy("pack_name").agg(F.max("capacity_tokens").alias("capacity_tokens")), "pack_name").select("pack_name", "capacity_tokens", "n_bins", "n_tokens", F.round(1 - F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens")), 6).alias("unused_share"))

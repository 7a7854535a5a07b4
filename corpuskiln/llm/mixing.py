"""Problem 8: sources in target shares.

Method: Pareto order sampling. A source's wanted size over its own size is its number of copies, capped
at max_repeats; whole copies take every document. For the fraction left, document i has inclusion
probability p_i in proportion to its size; those of p_i >= 1 are certain, and of the others the n
documents of smallest (u / (1 - u)) / (p / (1 - p)) are taken, u being a uniform number made from mix,
document and seed: a sample of fixed size. The n-th smallest rank is found by counting ranks in fine buckets (partial
aggregates), so a source with a third of all documents is never sorted by one task; only the bucket at
the border is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, settle

#: Buckets of ranks for each doubling of the odds.
FINE = 512


def allocate(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each source of a mix: ``mix_name, source, target_share, max_repeats, source_size, mix_size, wanted, copies, whole, part, reachable``.

    ``sizes`` has ``doc_id, source, n_tokens``. Sources of a mix without documents have size 0 and can't reach a share above 0. A null
    share counts as 0, a null max_repeats as 1; a repeated target row counts once.
    """
    sizes = sizes.select("doc_id", "source", "n_tokens")
    by_source = sizes.groupBy("source").agg(F.sum("n_tokens").alias("source_size"))
    t = targets.where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    m = t.join(by_source, "source", "left").withColumn("source_size", F.coalesce("source_size", F.lit(0)))
    total = m.groupBy("mix_name").agg(F.sum("source_size").alias("mix_size"))
    m = m.join(total, "mix_name").withColumn("wanted", F.col("target_share") * F.col("mix_size"))
    most = F.col("max_repeats") * F.col("source_size")
    m = m.withColumn("reachable", F.col("wanted") <= most)
    copies = F.when(F.col("source_size") > 0, F.least(F.col("wanted"), most.cast("double")) / F.col("source_size")).otherwise(F.lit(0.0))
    m = m.withColumn("copies", copies).withColumn("whole", F.floor("copies")).withColumn("part", F.col("copies") - F.floor("copies"))
    return m.select("mix_name", "source", "target_share", "max_repeats", "source_size", "mix_size", "wanted", "copies", "whole", "part", "reachable")


def once(sizes: DataFrame) -> DataFrame:
    """Each id once, with its largest size."""
    return sizes.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("m")).select("doc_id", "m.source", "m.n_tokens")


def select(sizes: DataFrame, targets: DataFrame, seed: int = 8) -> DataFrame:
    """``mix_name, source, doc_id, n_tokens, n_copies`` of the chosen documents. The number sampled makes the expected tokens the fraction
    wanted; documents without tokens or id are chosen by no mix, a repeated id counts once (its largest size)."""
    sizes = once(sizes)
    plan = settle(allocate(sizes, targets), "mix-plan")
    key = ["mix_name", "source"]
    small = lambda df: broadcast_if_small(df, 200)
    # p = c * size, or 1 where that is more: c is solved over the sizes that occur, largest first, so that the expected tokens are the fraction wanted
    hist = sizes.where("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count("*").alias("k")).join(small(plan.where("part > 0").select("mix_name", "source", "part", "source_size")), "source")
    down = Window.partitionBy(*key).orderBy(F.desc("n_tokens"))
    x = F.col("n_tokens").cast("double")
    solved = hist.withColumn("above", F.sum(x * F.col("k")).over(down) - x * F.col("k")).withColumn("squares", F.sum(x * x * F.col("k")).over(Window.partitionBy(*key).orderBy("n_tokens")))
    solved = solved.withColumn("c", (F.col("part") * F.col("source_size") - F.col("above")) / F.col("squares")).where((F.col("c") > 0) & (F.col("c") * x < 1))
    rate = settle(solved.groupBy(*key).agg(F.max_by("c", "n_tokens").alias("c")), "mix-rate")
    docs = sizes.where("n_tokens > 0").join(small(plan.where("copies > 0").select(*key, "whole", "part")), "source").join(small(rate), key, "left")
    u = (F.pmod(F.xxhash64("mix_name", "doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    p = F.when(F.col("part") > 0, F.coalesce("c", F.lit(1.0)) * F.col("n_tokens"))
    rank = F.when(F.col("p") < 1, F.log2(u / (1 - u)) - F.log2(F.col("p") / (1 - F.col("p"))))  # none for a certain document
    docs = docs.withColumn("p", p).withColumn("rank", rank).withColumn("bucket", F.floor(F.col("rank") * FINE))
    sums = docs.where("rank is not null").groupBy(*key, "bucket").agg(F.count("*").alias("n"), F.sum("p").alias("p"))
    w = Window.partitionBy(*key).orderBy("bucket")
    run = sums.withColumn("upto", F.sum("n").over(w)).withColumn("want", F.round(F.sum("p").over(Window.partitionBy(*key))))
    border = settle(run.where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want"))).select(*key, F.col("bucket").alias("border"), (F.col("want") - (F.col("upto") - F.col("n"))).alias("need")), "mix-border")
    marked = docs.join(small(border), key, "left")
    # every document is settled where it stands; only those of the border's bucket are ranked among each other
    at_border = F.coalesce(F.col("bucket") == F.col("border"), F.lit(False))
    drawn = F.coalesce(F.col("p") >= 1, F.lit(False)) | F.coalesce(F.col("bucket") < F.col("border"), F.lit(False))
    plain = marked.where(~at_border).withColumn("extra", drawn.cast("int"))
    ranked = marked.where(at_border).withColumn("extra", (F.row_number().over(Window.partitionBy(*key).orderBy("rank", "doc_id")) <= F.col("need")).cast("int"))
    out = [t.select(*key, "doc_id", "n_tokens", (F.col("whole") + F.col("extra")).cast("int").alias("n_copies")).where("n_copies > 0") for t in (plain, ranked)]
    return out[0].union(out[1])


def exhausted(selection: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix_name, source, tokens, wanted``: sources of which the sampling had to take every document max_repeats times and yet falls short of
    the tokens wanted."""
    got = selection.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("tokens"))
    a = allocate(once(sizes), targets).join(got, ["mix_name", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return a.where((F.col("tokens") >= F.col("max_repeats") * F.col("source_size")) & (F.col("tokens") < F.col("wanted"))).select("mix_name", "source", "tokens", "wanted")


def shares(selection: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix_name, source, target_share, actual_share, tokens, reachable``: what the chosen documents add up to."""
    got = selection.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("tokens"))
    a = allocate(once(sizes), targets).join(got, ["mix_name", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return a.withColumn("all", F.sum("tokens").over(Window.partitionBy("mix_name"))).select("mix_name", "source", "target_share", F.round(F.when(F.col("all") > 0, F.col("tokens") / F.col("all")).otherwise(0.0), 6).alias("actual_share"), "tokens", "reachable")

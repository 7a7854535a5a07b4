"""Problem 3: lines repeated over one site's pages.

Method: a weighted graph per site, its nodes the lines (compared without case, blanks and the digits
of numbers) weighted by the pages they stand on, its edges consecutive lines of a page weighted
likewise (lines follow each other if only lines without a letter stand between). Nodes with enough
pages and edges between them with enough pages stay; their connected components are the boilerplate
blocks, and every occurrence of a block's line is deleted. Which lines are repeated is settled by the
support of the nodes alone, as the task defines it; the edges settle what belongs to one block.

A line must stand on at least ``share`` of a site's pages, so a site keeps at most (lines of a page on
average) / share nodes however many pages it has: the components of one site are a bounded task. Lines
travel as hashes; pages per line are counted by two partial aggregations, so a site that holds a third
of all rows is spread over all tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, settle, ship

#: Pages a line must stand on, and the share of the site's pages.
MIN_PAGES, MIN_SHARE = 5, 0.1


def line_key(line: Column) -> Column:
    """The line without case, blanks and the digits of numbers; null if it has no letter."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(line), r"(?U)[\s\x{200b}\x{feff}]+", ""), r"\p{Nd}+", "0")
    return F.when(bare.rlike(r"\p{L}"), bare)


def lines_of(df: DataFrame, id_col: str, text_col: str, site_col: str, page_col: str) -> DataFrame:
    """``id, site, page, place, line_no, node``: a row per line with a letter; ``place`` counts these lines of a text alone, node is a 64-bit hash of site and line."""
    keyed = F.transform(F.split(text_col, "\n", -1), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("line_no")))
    rows = df.where(F.col(text_col).isNotNull() & F.col(site_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(site_col).alias("site"), F.xxhash64(site_col, page_col).alias("page"), F.posexplode(F.filter(keyed, lambda x: x["key"].isNotNull())).alias("place", "line")
    )
    return rows.select("id", "site", "page", "place", "line.line_no", F.xxhash64("site", "line.key").alias("node"))


def _blocks(edges: dict[int, set[int]], nodes: list[int]) -> dict[int, int]:
    """Smallest node of each node's component."""
    block: dict[int, int] = {}
    for n in sorted(nodes):
        if n in block:
            continue
        todo = [n]
        block[n] = n
        while todo:
            for x in edges.get(todo.pop(), ()):
                if x not in block:
                    block[x] = n
                    todo.append(x)
    return block


def site_blocks(lines: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``site, node, pages, site_pages, block``: the kept lines of every site and the block each belongs to."""
    ship(lines.sparkSession)
    on_pages = lines.select("site", "node", "page").distinct()
    site_pages = lines.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("site_pages"))
    nodes = on_pages.groupBy("site", "node").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    nodes = settle(nodes.join(site_pages, "site").where(F.col("pages") >= F.col("site_pages") * min_share), "site-nodes")
    kept = broadcast_if_small(nodes.select("node").distinct(), 40)
    own = lines.join(kept, "node", "left_semi")
    ahead = own.select("id", "place", "node", "page", "site").distinct()
    nxt = ahead.select("id", (F.col("place") - 1).alias("place"), F.col("node").alias("other"))
    edges = ahead.join(nxt, ["id", "place"]).where("node <> other").select("site", F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "page").distinct()
    edges = edges.groupBy("site", "a", "b").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    graph = nodes.select("site", F.col("node").alias("a"), F.col("node").alias("b")).union(edges.select("site", "a", "b"))

    def components(g: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        for a, b in zip(g["a"].tolist(), g["b"].tolist()):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        block = _blocks(near, list(near))
        return pd.DataFrame({"node": list(block), "block": list(block.values())})

    blocks = graph.groupBy("site").applyInPandas(components, "node bigint, block bigint")
    return nodes.join(blocks, "node").select("site", "node", "pages", "site_pages", "block")


def repeated_lines(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", site_col: str = "domain", page_col: str = "source_id", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``id, line_no, block, pages, site_pages`` of every occurrence of a block's line; line_no counts from 0 over all lines.

    Rows without a site, an id or a text have no repeated lines. Repeated rows of one id count once. A null page counts as
    one page of its own. Other columns are ignored.
    """
    lines = settle(lines_of(df, id_col, text_col, site_col, page_col), "site-lines")
    blocks = settle(site_blocks(lines, min_pages, min_share), "site-blocks")
    return lines.select("id", "line_no", "node").join(broadcast_if_small(blocks.drop("site"), 64), "node").select("id", "line_no", "block", "pages", "site_pages").distinct()


def block_report(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", site_col: str = "domain", page_col: str = "source_id", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``site, block, n_lines, least_pages, most_pages, site_pages`` of every boilerplate block."""
    lines = settle(lines_of(df, id_col, text_col, site_col, page_col), "site-lines")
    b = site_blocks(lines, min_pages, min_share)
    return b.groupBy("site", "block").agg(F.count("*").alias("n_lines"), F.min("pages").alias("least_pages"), F.max("pages").alias("most_pages"), F.max("site_pages").alias("site_pages"))


def without_repeated(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", **kw) -> DataFrame:
    """``id, text, n_removed, n_blocks``: each text without its repeated lines, and the blocks they were of. One row per id (of several texts the
    smallest); a text of nothing but repeated lines becomes empty, a null text stays null."""
    gone = repeated_lines(df, id_col, text_col, **kw).groupBy("id").agg(F.collect_set("line_no").alias("gone"), F.count_distinct("block").alias("n_blocks"))
    texts = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(text_col).alias("text"))
    parts = F.split("text", "\n", -1)
    kept = F.filter(F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains("gone", s["i"]))
    joined = F.array_join(F.transform(kept, lambda s: s["x"]), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(joined).alias("text")
    return texts.join(gone, "id", "left").select("id", text, F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"), F.coalesce("n_blocks", F.lit(0)).cast("int").alias("n_blocks"))

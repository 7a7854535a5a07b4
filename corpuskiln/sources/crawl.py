"""Breadth-first crawl as rounds over a frontier table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import broadcast_if_small, discard, settle
from .files import check_namespace


def robots_rules(files: DataFrame, agent: str = "*") -> DataFrame:
    """Robots files (``origin, body``) as ``origin, line_no, prefix, allow``: the rules of the first group that names the agent, else of
    the group for all. An origin without a group for it has no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(o, k, p, a) for o, body in zip(b["origin"], b["body"]) for k, (p, a) in enumerate(_group(body or "", agent))]
            yield pd.DataFrame(rows, columns=["origin", "line_no", "prefix", "allow"])

    return files.select("origin", "body").mapInPandas(run, "origin string, line_no int, prefix string, allow boolean")


def _group(body: str, agent: str) -> list[tuple[str, bool]]:
    groups: list[tuple[list[str], list[tuple[str, bool]]]] = []
    open_ = False
    for line in body.splitlines():
        name, colon, value = line.partition("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if not open_:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
            open_ = True
        elif name in ("allow", "disallow"):
            open_ = False
            if groups:  # to disallow nothing allows everything
                groups[-1][1].append(("/", True) if name == "disallow" and not value else (value, name == "allow"))
    own = agent.split("/")[0].lower()
    named = next((rules for names, rules in groups if any(n != "*" and n in own for n in names)), None)
    return named if named is not None else next((rules for names, rules in groups if "*" in names), [])


def robots_allowed(links: DataFrame, rules: DataFrame | None) -> DataFrame:
    """Links that the rules of their origin (``origin, line_no, prefix, allow``) let pass: the first rule whose prefix the path has decides; no rule allows."""
    if rules is None:
        return links
    r = broadcast_if_small(rules.select(F.col("origin").alias("__o"), "line_no", "prefix", "allow"), 300)
    path = F.regexp_extract("url", r"^[a-z][a-z0-9+.-]*://[^/?#]*(/[^#]*)?", 1)
    site = F.regexp_replace(U.origin(F.col("url")), "/$", "")
    j = links.join(r, (site == F.regexp_replace("__o", "/$", "")) & F.startswith(F.when(path == "", "/").otherwise(path), F.col("prefix")), "left")
    best = j.groupBy(*links.columns).agg(F.min_by("allow", "line_no").alias("ok"))
    return best.where(F.coalesce("ok", F.lit(True))).drop("ok")


def crawlable(links: DataFrame) -> DataFrame:
    """Links (``seed, url``) on the seed's own site, to no denied path, chart generator or asset."""
    u = F.col("url")
    return links.where(U.same_site(u, F.col("seed")) & ~U.path_denied(u) & ~U.has_ending(u, U.ASSETS) & ~U.is_generator(u))


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], max_pages: int = 320, per_seed: int = 80, robots: DataFrame | None = None) -> DataFrame:
    """``seed, url, depth, kind``: what is reached from each seed on its own site, breadth first; kind is ``page`` or ``pdf``.

    ``seeds``: ``seed``. ``fetch(links)`` takes ``seed, url, depth, ord`` and gives them back with ``ok`` (fetched as HTML), ``links`` (array of
    absolute URLs) and, if it knows, ``is_pdf`` (the body is a PDF). A link to a PDF is listed and not fetched. Pages, PDFs and failed fetches
    use up a seed's budget, pages and PDFs the whole one; skipped links use up none. A seed's links are ranked by (parent's place, place of
    the link), so a cut by budget is the same on every run; there is no bound on the depth. Every round is written out.
    """
    first = seeds.select(F.col("seed"), U.normalize_url(F.col("seed")).alias("url"), F.lit(0).alias("depth"), F.lit(1).cast("bigint").alias("ord")).dropDuplicates(["seed", "url"])
    frontier = settle(robots_allowed(crawlable(first), robots), "frontier")
    seen, used, found, got = settle(frontier.select("seed", "url"), "seen"), None, None, 0
    while not frontier.isEmpty():
        ranked = frontier.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("ord", "url")))
        ranked = ranked.join(used, "seed", "left") if used is not None else ranked.withColumn("used", F.lit(0))
        now = ranked.where(F.col("r") + F.coalesce("used", F.lit(0)) <= per_seed).select("seed", "url", "depth", "ord")
        named = U.is_pdf_url(F.col("url"))
        pages = fetch(now.where(~named))
        is_pdf = F.coalesce("is_pdf", F.lit(False)) if "is_pdf" in pages.columns else F.lit(False)
        pages = pages.select("seed", "url", "depth", "ord", F.when(is_pdf, "pdf").when(F.col("ok"), "page").otherwise("failed").alias("kind"), "links")
        pdfs = now.where(named).select("seed", "url", "depth", "ord", F.lit("pdf").alias("kind"), F.array().cast("array<string>").alias("links"))
        done = settle(pages.union(pdfs), "fetched")
        good = done.where("kind <> 'failed'")
        n = good.count()
        if n > max_pages - got:  # only the last round is cut
            n, good = max_pages - got, settle(good.orderBy("ord", "seed", "url").limit(max_pages - got), "good")
        got += n
        part = good.select("seed", "url", "depth", "kind")
        found = part if found is None else found.union(part)
        if got >= max_pages:
            break
        more = done.groupBy("seed").agg(F.count("*").alias("used"))
        used = settle(more if used is None else used.union(more).groupBy("seed").agg(F.sum("used").alias("used")), "used")
        out = good.where("kind = 'page'").select("seed", "depth", "ord", F.posexplode("links").alias("pos", "link"))
        out = crawlable(out.select("seed", U.normalize_url(F.col("link")).alias("url"), (F.col("depth") + 1).alias("depth"), F.struct("ord", "pos").alias("place")))
        fresh = robots_allowed(out.join(seen, ["seed", "url"], "left_anti").groupBy("seed", "url", "depth").agg(F.min("place").alias("place")), robots)
        last, old = frontier, seen
        frontier = settle(fresh.withColumn("ord", F.row_number().over(Window.partitionBy("seed").orderBy("place", "url")).cast("bigint")).select("seed", "url", "depth", "ord"), "frontier")
        seen = settle(seen.union(frontier.select("seed", "url")), "seen")
        for t in (last, old):
            discard(t)
    return found if found is not None else frontier.select("seed", "url", "depth", F.lit("page").alias("kind"))


def from_table(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A fetch hook over a table of pages: ``url, links``, with ``ok`` if it is there."""
    p = pages.select("url", "links", F.lit(True).alias("__ok")).dropDuplicates(["url"])
    return lambda want: want.join(p, "url", "left").select("seed", "url", "depth", "ord", F.coalesce("__ok", F.lit(False)).alias("ok"), F.coalesce("links", F.array().cast("array<string>")).alias("links"))


def pdf_links(links: DataFrame) -> DataFrame:
    """``url, filename`` of the PDF files to fetch, each URL once: by the URL, the content type or the crawl's own ``kind``."""
    by_type = U.is_pdf_url(F.col("url"), F.col("content_type") if "content_type" in links.columns else None)
    known = F.coalesce((F.col("kind") == "pdf"), F.lit(False)) if "kind" in links.columns else F.coalesce("is_pdf", F.lit(False)) if "is_pdf" in links.columns else F.lit(False)
    return links.where(by_type | known).select("url", U.pdf_filename(F.col("url")).alias("filename")).distinct()


def hand_off(crawled: DataFrame, download: Callable[[str], bytes | None], namespace: str = "web") -> DataFrame:
    """The crawl's PDFs as files of the PDF source (``source_id, path, sha256, content, namespace``), fetched by ``download`` on the workers; those
    that are no PDF or fail are left out. The namespace is checked before anything is fetched."""
    check_namespace(namespace)

    @F.pandas_udf("binary")
    def body(urls: pd.Series) -> pd.Series:
        def one(u):
            try:
                return download(u)
            except Exception:  # noqa: BLE001
                return None

        return pd.Series([one(u) for u in urls], dtype=object)

    f = pdf_links(crawled).withColumn("content", body("url")).where(is_pdf_body(F.col("content"), F.lit(None).cast("string")))
    return f.select(F.col("filename").alias("source_id"), F.col("url").alias("path"), F.sha2("content", 256).alias("sha256"), "content", F.lit(namespace).alias("namespace"))


def is_pdf_body(content, content_type):
    """Bytes that are a PDF by their first four, or by the content type."""
    return (F.substring(content, 1, 4) == F.lit("%PDF").cast("binary")) | F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("application/pdf"))

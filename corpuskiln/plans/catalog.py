"""Queries over the test tables, one or more for each operator, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import chunking, dataset, dedup, dense, embed, evaluate, faithfulness, golden, lexical, rewrite, search, store
from ..schema import chunk_id
from ..session import settle, shared_dir, spread
from ..session import table as one_table
from ..sources import crawl, files, manifest, pdf


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(one_table(spark, d, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# ---- tables as the operators take them, and the same as SQL ----

STRIP = r"regexp_replace({}, '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')"
CH = "ch AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC) = 1), kids AS (SELECT * FROM ch WHERE NOT is_parent)"
QS = "gold AS (SELECT * FROM golden_rows QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY built_at DESC) = 1), qs AS (SELECT question_id AS query_id, question AS text FROM gold WHERE question_id % 50 = 0)"
STOP = ", ".join(f"'{w}'" for w in lexical.STOPWORDS)
HTML = """'<html><head><title>' || coalesce(title, ' ') || '</title><style>p {{ x }}</style></head><body><h1>' || coalesce(title, '') || '</h1><!-- c --><p>' || replace(text, chr(10) || chr(10), '</p><p>') || '</p><a href="' || coalesce(url, '/about') || '">A &amp; B</a></body></html>'""".replace("{{", "{").replace("}}", "}")


def latest(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, of second deliveries the last."""
    return store.last_of_stored(table(spark, d, "chunks"), "chunk_id", ["created_at"])


def stored(spark: SparkSession, d: str) -> DataFrame:
    """The same, written once for queries that read it several times."""
    return settle(latest(spark, d), "chunks")


def gold(spark: SparkSession, d: str) -> DataFrame:
    return store.last_wins(table(spark, d, "golden_rows"), "question_id", ["built_at"])


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: questions whose id is divisible by 50."""
    return gold(spark, d).where("question_id % 50 = 0").select(F.col("question_id").alias("query_id"), F.col("question").alias("text"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that count as embedded: three quarters of them, by a hash of the id."""
    return latest(spark, d).where("substr(md5(chunk_id), 1, 1) < 'c'").select("chunk_id", "created_at")


VEC = "vec AS (SELECT chunk_id, created_at FROM ch WHERE substr(md5(chunk_id), 1, 1) < 'c')"


def pages_html(spark: SparkSession, d: str) -> DataFrame:
    """Documents as web pages: ``doc_id, url, html``."""
    html = F.concat(
        F.lit("<html><head><title>"), F.coalesce("title", F.lit(" ")), F.lit("</title><style>p { x }</style></head><body><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1><!-- c --><p>"),
        F.replace("text", F.lit("\n\n"), F.lit("</p><p>")), F.lit('</p><a href="'), F.coalesce("url", F.lit("/about")), F.lit('">A &amp; B</a></body></html>'),
    )
    return table(spark, d, "documents").select("doc_id", F.coalesce("url", F.lit("https://local.example/")).alias("url"), html.alias("html"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks, repeated rows once."""
    return table(spark, d, "blocks").dropDuplicates(["block_id"])


# ---- identity, text ----


@query("SELECT DISTINCT chunk_id, substr(sha256(concat_ws(chr(31), source_type, source_id, chunk_index, CASE WHEN is_parent THEN 'parent' ELSE 'child' END)), 1, 16) AS computed FROM chunks")
def chunk_ids(spark, d):
    return table(spark, d, "chunks").select("chunk_id", chunk_id(F.col("source_type"), F.col("source_id"), F.col("chunk_index"), F.col("is_parent")).alias("computed")).distinct()


SENT = r"""raw AS (SELECT {id} AS id, unnest(string_split(regexp_replace({text}, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace({text}, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), 1) AS i FROM {src}),
 bare AS (SELECT id, i, {strip} AS s FROM raw), kept AS (SELECT * FROM bare WHERE s <> ''),
 marked AS (SELECT id, i, s, CASE WHEN regexp_matches(lag(s) OVER (PARTITION BY id ORDER BY i), '(?i)(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])(?:{abbr})\.$') THEN 0 ELSE 1 END AS fresh FROM kept),
 grouped AS (SELECT id, i, s, sum(fresh) OVER (PARTITION BY id ORDER BY i) AS g FROM marked),
 sents AS (SELECT id, g - 1 AS pos, string_agg(s, ' ' ORDER BY i) AS sentence FROM grouped GROUP BY id, g)"""


def _sent(id_: str, text: str, src: str) -> str:
    return SENT.format(id=id_, text=text, src=src, strip=STRIP.format("s"), abbr=X.ABBREVIATIONS)


@query(f"WITH {_sent('doc_id', 'text', 'documents')} SELECT id AS doc_id, pos::BIGINT AS pos, md5(sentence) AS sentence FROM sents")
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "s")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.md5("s").alias("sentence"))


@query(f"WITH {CH} SELECT chunk_id, greatest(1, length(text) // 4)::INTEGER AS n_tokens, substr(text, 1, 400) AS cut FROM ch")
def token_counts(spark, d):
    return latest(spark, d).select("chunk_id", X.count_tokens(F.col("text")).alias("n_tokens"), X.truncate_tokens(F.col("text"), 100).alias("cut"))


@query(f"WITH {CH}, t AS (SELECT source_type, list_sort(list(greatest(1, length(text) // 4)::INTEGER)) AS l, count(*) AS n FROM kids GROUP BY 1) SELECT source_type, l[least(n - 1, floor(0.1 * n))::INTEGER + 1] AS p10, l[least(n - 1, floor(0.5 * n))::INTEGER + 1] AS p50, l[least(n - 1, floor(0.9 * n))::INTEGER + 1] AS p90, n FROM t")
def token_percentiles(spark, d):
    t = latest(spark, d).where("not is_parent").select("source_type", X.count_tokens(F.col("text")).alias("t"))
    return store.nearest_rank(t, ["source_type"], "t", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


def _windows(id_: str, text: str, src: str, target: int, overlap: int, least: int) -> str:
    """CTEs up to ``win``: id, no, text, ov; the recursion goes over running totals of the sentences' sizes."""
    end = "greatest({0} + 1, len(list_filter(p.p, lambda x: x <= p.p[{0} + 1] + {1})) - 1)::BIGINT"
    back = f"greatest(w.a + 1, coalesce(list_max(list_filter(range(w.a, w.z), lambda k: pp.p[w.z + 1] - pp.p[k + 1] >= {overlap})), w.a))"
    return f"""{_sent(id_, text, src)}, arr AS (SELECT id, list(sentence ORDER BY pos) AS s, list(greatest(1, length(sentence) // 4)::INTEGER ORDER BY pos) AS t FROM sents GROUP BY id),
 pre AS (SELECT id, s, len(s) AS n, list_transform(range(0, len(t) + 1), lambda k: coalesce(list_sum(t[1:k]), 0)::INTEGER) AS p FROM arr),
 w AS (SELECT id, 0 AS no, 0::BIGINT AS a, {end.format('0', target)} AS z FROM pre p
   UNION ALL SELECT q.id, q.no + 1, q.nx, {end.format('q.nx', target)} FROM (SELECT w.id, w.no, {back} AS nx FROM w JOIN pre pp USING (id) WHERE w.z < pp.n) q JOIN pre p ON p.id = q.id),
 txt AS (SELECT w.id, no, array_to_string(s[a + 1:z], ' ') AS text, CASE WHEN no = 0 THEN 0 ELSE {overlap} END AS ov, count(*) OVER (PARTITION BY w.id) AS m FROM w JOIN pre ON pre.id = w.id),
 tail AS (SELECT id, text FROM txt WHERE m > 1 AND no = m - 1 AND greatest(1, length(text) // 4) < {least}),
 win AS (SELECT txt.id, no, CASE WHEN tail.id IS NOT NULL AND no = m - 2 THEN txt.text || ' ' || tail.text ELSE txt.text END AS text, ov FROM txt LEFT JOIN tail ON tail.id = txt.id WHERE NOT (tail.id IS NOT NULL AND no = m - 1))"""


@query(f"WITH RECURSIVE {_windows('doc_id', 'text', 'documents', 400, 60, 80)} SELECT id AS doc_id, no AS window_no, md5(text) AS text, ov AS overlap_tokens FROM win")
def pack_windows(spark, d):
    w = chunking.pack_texts(table(spark, d, "documents"), "doc_id")
    return w.select("doc_id", "window_no", F.md5("text").alias("text"), "overlap_tokens")


@query(f"SELECT doc_id, nullif({STRIP.format('replace(title, chr(38), chr(38))')}, '') AS title FROM documents")
def page_titles(spark, d):
    return pages_html(spark, d).select("doc_id", X.html_title(F.col("html")).alias("title"))


@query(
    rf"""WITH h AS (SELECT doc_id, {HTML} AS x FROM documents), a AS (SELECT doc_id, regexp_replace(x, '(?is)<style.*?>.*?</style>', ' ', 'g') AS x FROM h), b AS (SELECT doc_id, regexp_replace(x, '(?is)<!--.*?-->', ' ', 'g') AS x FROM a),
 c AS (SELECT doc_id, regexp_replace(regexp_replace(x, '(?is)</p>', chr(10) || chr(10), 'g'), '(?is)</h[1-6]>', chr(10) || chr(10), 'g') AS x FROM b), e AS (SELECT doc_id, replace(regexp_replace(x, '(?is)<[^>]+>', ' ', 'g'), '&amp;', '&') AS x FROM c),
 f AS (SELECT doc_id, regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM e) SELECT doc_id, md5({STRIP.format('x')}) AS text FROM f"""
)
def page_texts(spark, d):
    return pages_html(spark, d).select("doc_id", F.md5(X.html_text(F.col("html"))).alias("text"))


_LINKS = ['<a href="{}">x</a>', '<A HREF = \'../up/./x.html?q=1#f\'>', '<a href="menu/a.html">', '<a href="b">', '<a href="#top">', '<a href="mailto:a@b.example">', '<a href="//cdn.example/l/../m">', '<a href="?page=2">', '<script>go("./k/c.php"); go("menu/a.html")</script>']
_DIR = "regexp_replace(regexp_replace(base, '^([a-z]+://[^/]*)$', '\\1/'), '[^/]*$', '')"


@query(
    rf"""WITH u AS (SELECT doc_id, coalesce(url, 'https://local.example/x/y') AS base FROM documents), p AS (SELECT doc_id, base, regexp_extract(base, '^([a-z]+://[^/]*)', 1) AS o, {_DIR} AS dir FROM u),
 l AS (SELECT doc_id, [base, (CASE WHEN dir = o || '/' THEN dir ELSE regexp_replace(dir, '[^/]+/$', '') END) || 'up/x.html?q=1#f', o || '/menu/a.html', dir || 'b', 'https://cdn.example/m', regexp_replace(base, '[?#].*$', '') || '?page=2', o || '/k/c.php'] AS links FROM p)
 SELECT doc_id, generate_subscripts(links, 1) - 1 AS pos, unnest(links) AS link FROM l"""
)
def page_links(spark, d):
    base = F.coalesce("url", F.lit("https://local.example/x/y"))
    html = F.replace(F.lit("".join(_LINKS)), F.lit("{}"), base)
    return table(spark, d, "documents").select("doc_id", F.posexplode(U.links(html, base)).alias("pos", "link"))


_P = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1))"


@query(
    rf"""SELECT DISTINCT url, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':\d+$', ''), '^www\.', '') AS site, regexp_matches({_P}, '^({"|".join(U.PATH_DENY)})(/|$)') AS denied, ends_with({_P}, '.pdf') OR coalesce(contains(lower(content_type), 'application/pdf'), false) AS is_pdf, regexp_matches({_P}, '\.({"|".join(U.ASSETS)})$') AS is_asset,
 len(list_intersect(list_transform(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: lower(string_split(x, '=')[1])), [{", ".join(f"'{k}'" for k in U.GENERATOR_KEYS)}])) > 0 AS is_generator, contains(lower(content_type), 'html') AS html FROM crawl_pages WHERE status = 200"""
)
def url_filters(spark, d):
    p, u = table(spark, d, "crawl_pages").where("status = 200"), F.col("url")
    return p.select("url", U.site(u).alias("site"), U.path_denied(u).alias("denied"), U.is_pdf_url(u, F.col("content_type")).alias("is_pdf"), U.has_ending(u, U.ASSETS).alias("is_asset"), U.is_generator(u).alias("is_generator"), F.contains(F.lower("content_type"), F.lit("html")).alias("html")).distinct()


@query(r"SELECT DISTINCT url, lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || CASE WHEN regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') END || regexp_extract(url, '(\?[^#]*)', 1) AS normal FROM crawl_pages")
def url_normal(spark, d):
    return table(spark, d, "crawl_pages").select("url", U.normalize_url(F.col("url")).alias("normal")).distinct()


_NAME = r"regexp_extract(url_decode(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '([^/]*)$', 1)"


@query(rf"SELECT DISTINCT url, substr(coalesce(nullif(trim(regexp_replace(CASE WHEN lower({_NAME}) LIKE '%.pdf' OR {_NAME} = '' THEN {_NAME} ELSE {_NAME} || '.pdf' END, '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'download.pdf'), 1, 120) AS filename FROM crawl_pages WHERE is_pdf OR ends_with({_P}, '.pdf') OR contains(lower(content_type), 'application/pdf')")
def pdf_harvest(spark, d):
    return crawl.pdf_links(table(spark, d, "crawl_pages"))


_NORMAL = r"lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || CASE WHEN regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') END || regexp_extract(url, '(\?[^#]*)', 1)"
_SKIPPED = rf"regexp_matches({_P}, '^({'|'.join(U.PATH_DENY)})(/|$)') OR regexp_matches({_P}, '\.({'|'.join(U.ASSETS)})$') OR len(list_intersect(list_transform(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: lower(string_split(x, '=')[1])), [{', '.join(f"'{k}'" for k in U.GENERATOR_KEYS)}])) > 0"


@query(
    rf"""WITH RECURSIVE n AS (SELECT DISTINCT domain, {_NORMAL} AS url FROM crawl_pages WHERE status = 200 AND NOT is_pdf AND domain IS NOT NULL), p AS (SELECT domain, url, row_number() OVER (PARTITION BY domain ORDER BY url) AS r, ({_SKIPPED}) AS skipped, ends_with({_P}, '.pdf') AS pdf FROM n),
 t AS (SELECT domain, url AS seed, url, r, pdf, 0 AS depth FROM p WHERE r = 1 AND NOT skipped UNION ALL SELECT p.domain, t.seed, p.url, p.r, p.pdf, t.depth + 1 FROM t JOIN p ON p.domain = t.domain AND p.r > 1 AND (p.r + 8) // 10 = t.r AND NOT t.pdf WHERE NOT p.skipped)
 SELECT seed, url, depth, CASE WHEN pdf THEN 'pdf' ELSE 'page' END AS kind FROM t"""
)
def crawl_reach(spark, d):
    """Crawl over all known pages of the domains, without a budget that one reaches. A page links ten others of its domain, those after its own
    tenfold place in the order of URLs, then its domain's first page and one page elsewhere."""
    from pyspark.sql import Window

    url = U.normalize_url(F.col("url"))
    ok = table(spark, d, "crawl_pages").where("status = 200 and not is_pdf and domain is not null").select("domain", url.alias("url")).distinct()
    p = settle(ok.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy("url"))), "pages")
    kids = p.where("r > 1").groupBy("domain", F.expr("(r + 8) div 10").alias("r")).agg(F.array_sort(F.collect_list("url")).alias("kids"))
    home = p.where("r = 1").select("domain", F.col("url").alias("seed"))
    pages = p.join(kids, ["domain", "r"], "left").join(home, "domain").select("url", F.concat(F.coalesce("kids", F.array().cast("array<string>")), F.array("seed", F.lit("https://elsewhere.example/"))).alias("links"))
    return crawl.crawl(home.select("seed"), crawl.from_table(settle(pages, "linked")), max_pages=1 << 40, per_seed=1 << 40)


# ---- documents ----


_RUNNING = (
    rf"""WITH b AS (SELECT DISTINCT ON (block_id) * FROM blocks), p AS (SELECT source_id, page, block_pos, text FROM b WHERE page IS NOT NULL), l AS (SELECT source_id, page, block_pos, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM p),
 k AS (SELECT *, replace(lower(regexp_replace({STRIP.format('line')}, '[\s\p{{Z}}\x{{85}}]+', ' ', 'g')), 'ß', 'ss') AS k FROM l), s AS (SELECT source_id, k, count(DISTINCT page) AS n FROM k WHERE k <> '' AND length({STRIP.format('line')}) <= 80 GROUP BY 1, 2), t AS (SELECT source_id, count(DISTINCT page) AS m FROM p GROUP BY 1),
 r AS (SELECT s.source_id, k FROM s JOIN t USING (source_id) WHERE n >= 2 AND n >= 0.2 * m) SELECT source_id, page, block_pos, md5(string_agg(line, chr(10) ORDER BY i)) AS text FROM k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.source_id = k.source_id AND r.k = k.k) GROUP BY 1, 2, 3"""
)


def _without_running(spark, d, share):
    p = blocks(spark, d).where("page is not null").select("source_id", "page", F.col("block_pos").alias("pos"), "text")
    return chunking.strip_running_lines(p, share=share).select("source_id", "page", F.col("pos").alias("block_pos"), F.md5("text").alias("text"))


@query(_RUNNING)
def running_lines(spark, d):
    return _without_running(spark, d, 0.2)


@query(_RUNNING.replace("0.2 * m", "0.5 * m"))
def running_lines_half(spark, d):
    return _without_running(spark, d, 0.5)


@query("WITH b AS (SELECT DISTINCT ON (block_id) * FROM blocks) SELECT block_id, sum(is_heading::INTEGER) OVER w AS section_no, last_value(CASE WHEN is_heading THEN text END IGNORE NULLS) OVER w AS section FROM b WINDOW w AS (PARTITION BY source_id ORDER BY block_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def section_groups(spark, d):
    return chunking.sections(blocks(spark, d)).select("block_id", "section_no", "section")


@query("WITH b AS (SELECT DISTINCT ON (block_id) * FROM blocks) SELECT source_id, min(page) AS page_min, max(page) AS page_max, round(avg((length(trim(coalesce(text, ''))) < 40)::INTEGER), 6) AS scanned_share FROM b WHERE NOT is_heading GROUP BY 1")
def page_spans(spark, d):
    b = blocks(spark, d).where("not is_heading")
    return b.groupBy("source_id").agg(F.min("page").alias("page_min"), F.max("page").alias("page_max")).join(pdf.scanned_share(b).select("source_id", "scanned_share"), "source_id")


def _docs(spark, d):
    return store.last_wins(table(spark, d, "pdf_documents"), "source_id", ["ingested_at"]).select("source_id", "title", "lang", "backend", "page_count")


def _document_chunks_sql(parents: bool) -> str:
    head = "CASE WHEN section IS NULL OR section = '' OR starts_with(ltrim({0}), section) THEN {0} ELSE section || chr(10) || chr(10) || {0} END"
    parent = f"UNION ALL SELECT source_id, section_no, section, -1 AS rank, true AS is_parent, substr(body, 1, 8000) AS text, page_start AS page, greatest(1, length(body) // 4) AS token_count, 0 AS overlap_tokens FROM sec WHERE body <> ''" if parents else ""
    return f"""WITH RECURSIVE b AS (SELECT DISTINCT ON (block_id) * FROM blocks), s0 AS (SELECT *, sum(is_heading::INTEGER) OVER w AS section_no, last_value(CASE WHEN is_heading THEN text END IGNORE NULLS) OVER w AS section FROM b WINDOW w AS (PARTITION BY source_id ORDER BY block_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 own AS (SELECT * FROM s0 WHERE NOT is_heading), sec0 AS (SELECT source_id, section_no, any_value(section) AS section, min(page) AS page_start, string_agg(text, chr(10) ORDER BY block_pos) FILTER (WHERE block_type = 'text') AS j, list({{'t': text, 'p': page}} ORDER BY block_pos) FILTER (WHERE block_type = 'text') AS prose FROM own GROUP BY 1, 2),
 sec AS (SELECT *, source_id || chr(31) || section_no AS sid, {STRIP.format("coalesce(j, '')")} AS body FROM sec0), body AS (SELECT sid, body FROM sec WHERE body <> ''), {_windows('sid', 'body', 'body', 400, 60, 80)},
 rows0 AS (SELECT source_id, section_no, section, win.no AS rank, false AS is_parent, {head.format('win.text')} AS text, coalesce(list_filter(prose, lambda x: contains(win.text, substr(x.t, 1, 80)))[1].p, page_start) AS page, NULL::BIGINT AS token_count, ov AS overlap_tokens FROM win JOIN sec ON sec.sid = win.id),
 special AS (SELECT own.source_id, own.section_no, own.section, row_number() OVER (PARTITION BY own.source_id, own.section_no ORDER BY block_pos) - 1 + coalesce(n, 0) AS rank, false AS is_parent, {head.format('own.text').replace('section', 'own.section')} AS text, own.page, NULL::BIGINT AS token_count, 0 AS overlap_tokens FROM own LEFT JOIN (SELECT source_id, section_no, count(*) AS n FROM rows0 GROUP BY 1, 2) c USING (source_id, section_no) WHERE block_type <> 'text'),
 every AS (SELECT * FROM rows0 UNION ALL SELECT * FROM special {parent}), numbered AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY section_no, rank) - 1 AS chunk_index FROM every)
 SELECT substr(sha256(concat_ws(chr(31), 'pdf', source_id, chunk_index, CASE WHEN is_parent THEN 'parent' ELSE 'child' END)), 1, 16) AS chunk_id, source_id, chunk_index, section, page, md5(text) AS text, is_parent, coalesce(token_count, greatest(1, length(text) // 4)) AS token_count, overlap_tokens FROM numbered"""


def _document_chunks(spark, d, strategy):
    c = chunking.chunk_documents(blocks(spark, d), _docs(spark, d), strategy)
    return c.select("chunk_id", "source_id", "chunk_index", "section", "page", F.md5("text").alias("text"), "is_parent", "token_count", "overlap_tokens")


@query(_document_chunks_sql(False))
def chunk_documents(spark, d):
    return _document_chunks(spark, d, "structure")


@query(_document_chunks_sql(True))
def chunk_parent_child(spark, d):
    return _document_chunks(spark, d, "parent_child")


@query(
    rf"""WITH b AS (SELECT DISTINCT ON (block_id) * FROM blocks), p AS (SELECT source_id, page, string_agg(CASE WHEN is_heading THEN '# ' || text ELSE text END, chr(10) ORDER BY block_pos) AS text FROM b WHERE page IS NOT NULL AND block_type = 'text' GROUP BY 1, 2),
 l AS (SELECT source_id, page, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM p), h AS (SELECT *, length(regexp_extract({STRIP.format('line')}, '^(#{{1,6}})\s+.*$', 1)) AS level FROM l),
 g AS (SELECT *, sum((level > 0)::INTEGER) OVER w AS part, last_value(CASE WHEN level > 0 THEN trim(regexp_replace(regexp_extract({STRIP.format('line')}, '^#{{1,6}}\s+(.*)$', 1), '[*_`#]+', '', 'g')) END IGNORE NULLS) OVER w AS heading FROM h WINDOW w AS (PARTITION BY source_id, page ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 o AS (SELECT source_id, page, part, 0 AS kind, heading AS text, heading, true AS is_heading FROM g WHERE level > 0 UNION ALL SELECT source_id, page, part, 1, {STRIP.format("string_agg(line, chr(10) ORDER BY i)")} AS text, any_value(heading), false FROM g WHERE level = 0 GROUP BY 1, 2, 3 HAVING {STRIP.format("string_agg(line, chr(10) ORDER BY i)")} <> '')
 SELECT source_id, page, row_number() OVER (PARTITION BY source_id ORDER BY page, part, kind) - 1 AS block_pos, md5(text) AS text, heading, is_heading FROM o"""
)
def markdown_blocks(spark, d):
    """Blocks as markdown pages and back."""
    line = F.when(F.col("is_heading"), F.concat(F.lit("# "), F.col("text"))).otherwise(F.col("text"))
    p = blocks(spark, d).where("page is not null and block_type = 'text'").groupBy("source_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_pos", line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return chunking.markdown_blocks(p).select("source_id", "page", "block_pos", F.md5("text").alias("text"), "heading", "is_heading")


_PAGE_TEXT = rf"""h AS (SELECT doc_id, title, url, {HTML} AS x FROM documents), a AS (SELECT * REPLACE (regexp_replace(x, '(?is)<style.*?>.*?</style>', ' ', 'g') AS x) FROM h), b0 AS (SELECT * REPLACE (regexp_replace(x, '(?is)<!--.*?-->', ' ', 'g') AS x) FROM a),
 c AS (SELECT * REPLACE (regexp_replace(regexp_replace(x, '(?is)</p>', chr(10) || chr(10), 'g'), '(?is)</h[1-6]>', chr(10) || chr(10), 'g') AS x) FROM b0), e AS (SELECT * REPLACE (replace(regexp_replace(x, '(?is)<[^>]+>', ' ', 'g'), '&amp;', '&') AS x) FROM c), f AS (SELECT * REPLACE (regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS x) FROM e),
 pg AS (SELECT coalesce(url, 'https://local.example/') || '#' || doc_id AS url, nullif({STRIP.format("coalesce(title, ' ')")}, '') AS title, {STRIP.format('x')} AS text FROM f WHERE length({STRIP.format('x')}) >= 200)"""


@query(f"WITH RECURSIVE {_PAGE_TEXT}, {_windows('url', 'text', 'pg', 550, 82, 80)} SELECT substr(sha256(concat_ws(chr(31), 'web', id, no, 'child')), 1, 16) AS chunk_id, md5(win.text) AS text, id AS source_id, no AS chunk_index, title, greatest(1, length(win.text) // 4) AS token_count, ov AS overlap_tokens FROM win JOIN pg ON pg.url = win.id")
def chunk_pages(spark, d):
    url = F.concat("url", F.lit("#"), "doc_id")
    p = pages_html(spark, d).select(url.alias("url"), X.html_title(F.col("html")).alias("title"), X.html_text(F.col("html")).alias("text"))
    return chunking.chunk_pages(p).select("chunk_id", F.md5("text").alias("text"), "source_id", "chunk_index", "title", "token_count", "overlap_tokens")


_SECTION_TEXT = f"b AS (SELECT DISTINCT ON (block_id) * FROM blocks), s0 AS (SELECT *, sum(is_heading::INTEGER) OVER (PARTITION BY source_id ORDER BY block_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_no FROM b), sec AS (SELECT source_id || chr(31) || section_no AS sid, {STRIP.format('string_agg(text, chr(10) ORDER BY block_pos)')} AS body FROM s0 WHERE NOT is_heading AND block_type = 'text' GROUP BY source_id, section_no)"


@query(
    rf"""WITH {_SECTION_TEXT}, {_sent('sid', 'body', 'sec')}, wd AS (SELECT id, pos, ('0x' || right(md5(w), 2))::INTEGER AS k FROM (SELECT id, pos, unnest(regexp_extract_all(lower(sentence), '[a-z0-9]+')) AS w FROM sents)), ct AS (SELECT id, pos, k, 1 + ln(count(*)) AS raw FROM wd GROUP BY 1, 2, 3), v AS (SELECT id, pos, k, (raw / sqrt(sum(raw * raw) OVER (PARTITION BY id, pos)))::FLOAT::DOUBLE AS x FROM ct),
 sm AS (SELECT a.id, a.pos + 1 AS pos, sum(a.x * c.x) AS sim FROM v a JOIN v c ON c.id = a.id AND c.pos = a.pos + 1 AND c.k = a.k GROUP BY 1, 2), q AS (SELECT sents.id, sents.pos, sentence, greatest(1, length(sentence) // 4) AS t, CASE WHEN sents.pos > 0 THEN round(coalesce(sim, 0), 6) END AS sim FROM sents LEFT JOIN sm ON sm.id = sents.id AND sm.pos = sents.pos),
 lw AS (SELECT id, quantile_cont(sim, 0.25) AS low FROM q GROUP BY 1), pt AS (SELECT q.*, sum(coalesce((sim < low)::INTEGER, 0)) OVER (PARTITION BY q.id ORDER BY pos) AS part FROM q JOIN lw ON lw.id = q.id), fl AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY id, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 60 AS fill FROM pt),
 nw AS (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY part, fill) - 1 AS window_no FROM fl) SELECT string_split(id, chr(31))[1] AS source_id, string_split(id, chr(31))[2]::BIGINT AS section_no, window_no, md5(string_agg(sentence, ' ' ORDER BY pos)) AS text FROM nw GROUP BY id, window_no"""
)
def semantic_windows(spark, d):
    return chunking.semantic_sections(blocks(spark, d), embed.Embedder(dim=256), 60).withColumn("text", F.md5("text"))


@query(r"WITH b AS (SELECT DISTINCT ON (block_id) * FROM blocks), t AS (SELECT block_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*\|') AND NOT regexp_matches(x, '^\s*\|[\s|:-]*$') AND regexp_replace(x, '[|\s]', '', 'g') <> '') AS r FROM b WHERE block_type = 'table') SELECT block_id, len(r)::INTEGER AS n_rows FROM t WHERE len(r) >= 2")
def filled_tables(spark, d):
    return blocks(spark, d).where("block_type = 'table'").select("block_id", F.size(X.table_rows(F.col("text"))).alias("n_rows")).where("n_rows >= 2")


_FIGURES = rf"WITH b AS (SELECT DISTINCT ON (block_id) * FROM blocks) SELECT block_id FROM b WHERE block_type = 'figure' AND length({STRIP.format('text')}) >= 20 AND len(regexp_extract_all({STRIP.format('text')}, '\p{{L}}')) >= 0.35 * length({STRIP.format('text')})"


@query(_FIGURES)
def kept_figures(spark, d):
    return blocks(spark, d).where("block_type = 'figure'").where(X.keep_figure_text(F.col("text"), 20)).select("block_id")


@query(_FIGURES.replace(">= 20", ">= 40"))
def kept_figures_default(spark, d):
    return blocks(spark, d).where("block_type = 'figure'").where(X.keep_figure_text(F.col("text"))).select("block_id")


@query(rf"SELECT source_id, CASE WHEN lower({STRIP.format('title')}) IN ('', '(anonymous)', 'untitled', 'unknown') THEN NULL ELSE {STRIP.format('title')} END AS title FROM (SELECT * FROM pdf_documents QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY ingested_at DESC) = 1)")
def real_titles(spark, d):
    return _docs(spark, d).select("source_id", X.real_title(F.col("title")).alias("title"))


# ---- duplicates ----


@query(f"WITH {CH} SELECT chunk_id FROM ch WHERE is_parent UNION ALL SELECT chunk_id FROM kids QUALIFY row_number() OVER (PARTITION BY source_id, md5({STRIP.format('text')}) ORDER BY chunk_index, chunk_id) = 1")
def dedup_in_source(spark, d):
    return dedup.keep_first(latest(spark, d), ["chunk_index", "chunk_id"], ["source_id"]).select("chunk_id")


@query(f"WITH {CH} SELECT chunk_id FROM ch WHERE is_parent UNION ALL SELECT chunk_id FROM kids QUALIFY row_number() OVER (PARTITION BY md5({STRIP.format('text')}) ORDER BY source_id, chunk_index, chunk_id) = 1")
def dedup_global(spark, d):
    return dedup.keep_first(latest(spark, d), ["source_id", "chunk_index", "chunk_id"]).select("chunk_id")


@query()
def dedup_near(spark, d):
    return dedup.near_dedup(latest(spark, d)).select("chunk_id")


@query(
    rf"""WITH {CH}, w AS (SELECT chunk_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))) AS w FROM kids), s AS (SELECT w, len(w) AS n, min(chunk_id) AS id FROM w WHERE len(w) > 0 GROUP BY 1),
 t AS (SELECT id, n, unnest(w) AS x FROM s), df AS (SELECT x, count(*) AS k FROM t GROUP BY 1), r AS (SELECT id, n, x, row_number() OVER (PARTITION BY id ORDER BY k, x) AS p FROM t JOIN df USING (x)), pr AS (SELECT * FROM r WHERE p <= n - ceil(0.9 * n) + 1),
 cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM pr a JOIN pr b ON a.x = b.x AND a.id < b.id AND a.n >= 0.9 * b.n AND b.n >= 0.9 * a.n)
 SELECT cand.a, cand.b FROM cand JOIN s x ON x.id = cand.a JOIN s y ON y.id = cand.b WHERE len(list_intersect(x.w, y.w)) / (x.n + y.n - len(list_intersect(x.w, y.w))) >= 0.9"""
)
def dedup_near_links(spark, d):
    """Links of near duplicates by bands against all pairs in SQL: shows the recall."""
    return dedup.near_links(latest(spark, d).where("not is_parent")).select("a.chunk_id", F.col("b.chunk_id").alias("__b")).toDF("a", "b")


# ---- retrieval ----

EMB = """{name} AS (SELECT id, b, (1 + ln(n)) / sqrt(sum((1 + ln(n)) * (1 + ln(n))) OVER (PARTITION BY id)) AS weight FROM (SELECT id, b, count(*) AS n FROM (SELECT {id} AS id, ('0x' || right(md5(w), 3))::INTEGER & 1023 AS b FROM (SELECT {id}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w FROM {src})) GROUP BY 1, 2))"""
QV, CV = EMB.format(name="qv", id="query_id", text="text", src="qs"), EMB.format(name="cv", id="chunk_id", text="text", src="ch")
DENSE = "dense AS (SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM (SELECT qv.id AS query_id, cv.id AS chunk_id, round(1 - sum(cv.weight * qv.weight), 9) AS distance FROM cv JOIN qv USING (b) GROUP BY 1, 2) QUALIFY rank <= {k})"
LEX = rf"""qt AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[\p{{{{L}}}}\p{{{{N}}}}]+')) AS term FROM qs) WHERE term NOT IN ({STOP})), qn AS (SELECT query_id, count(*) AS m FROM qt GROUP BY 1),
 tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\p{{{{L}}}}\p{{{{N}}}}]+')) AS term FROM kids) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
 hit AS (SELECT query_id, chunk_id, count(*) AS matched, round(sum(1 + ln(tf)), 9) AS score FROM tf JOIN qt USING (term) GROUP BY 1, 2), fulls AS (SELECT query_id, count(*) AS f FROM hit JOIN qn USING (query_id) WHERE matched = m GROUP BY 1),
 lex AS (SELECT query_id, chunk_id, matched, score, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, score DESC, chunk_id) AS rank FROM hit JOIN qn USING (query_id) LEFT JOIN fulls USING (query_id) WHERE coalesce(f, 0) < {{k}} OR matched = m QUALIFY rank <= {{k}})""".replace("{{{{", "{{").replace("}}}}", "}}")
FUSED = "fused AS (SELECT coalesce(a.query_id, l.query_id) AS query_id, coalesce(a.chunk_id, l.chunk_id) AS chunk_id, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + l.rank), 0), 9) AS rrf_score, a.rank AS dense_rank, l.rank AS lexical_rank FROM (SELECT dense.* FROM dense JOIN kids USING (chunk_id)) a FULL JOIN lex l ON a.query_id = l.query_id AND a.chunk_id = l.chunk_id), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS final_rank FROM fused)"


def _search_sql(k: int) -> str:
    return f"{CH}, {QS}, {QV}, {CV}, {DENSE.format(k=k)}, {LEX.format(k=k)}, {FUSED}"


@query(f"WITH {CH}, {CV} SELECT id AS chunk_id, b AS bucket, round(weight, 6) AS weight FROM cv")
def hash_embedding(spark, d):
    return embed.sparse(latest(spark, d)).select("chunk_id", "bucket", F.round("weight", 6).alias("weight"))


@query(f"WITH {CH}, {QS}, {QV}, {CV}, {DENSE.format(k=10)} SELECT query_id, chunk_id, rank, round(distance, 6) AS distance FROM dense")
def hash_cosine_topk(spark, d):
    return dense.sparse_topk(embed.hashed(latest(spark, d)), embed.hashed(questions(spark, d), "query_id"), 10).select("query_id", "chunk_id", "rank", F.round("distance", 6).alias("distance"))


_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


def _nearest(spark, d, k):
    e = table(spark, d, "embeddings")
    return dense.dense_topk(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k, "vec_id")


@query(f"SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(1 - {_DOT}, 6) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - {_DOT}, b.vec_id)::INTEGER AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 10")
def dense_topk(spark, d):
    return _nearest(spark, d, 10).withColumn("distance", F.round("distance", 6))


@query(f"WITH t AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - {_DOT}, b.vec_id)::INTEGER AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 20) SELECT query_id, chunk_id, rank FROM t WHERE label < 5")
def dense_filtered(spark, d):
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit(False).alias("is_parent"), F.when(F.col("label") < 5, "low").otherwise("high").alias("source_type"))
    return dense.after_filter(_nearest(spark, d, 20), own, source_type="low").select("query_id", "chunk_id", "rank")


@query(f"WITH {CH}, {QS}, {LEX.format(k=20)} SELECT query_id, chunk_id, matched, round(score, 6) AS score, rank FROM lex")
def lexical_topk(spark, d):
    return lexical.lexical_topk(latest(spark, d).where("not is_parent"), questions(spark, d), 20).withColumn("score", F.round("score", 6))


@query(
    rf"""WITH {CH}, {QS}, q AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM qs) WHERE term <> ''), w AS (SELECT chunk_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM kids), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
 tf AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
 SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY 1, 2 QUALIFY rank <= 20"""
)
def bm25_topk(spark, d):
    return lexical.bm25_topk(latest(spark, d).where("not is_parent"), questions(spark, d), 20)


def _search(spark, d, k, final, ch=None):
    ch, q = ch or stored(spark, d), questions(spark, d)
    return search.search_chunks(ch, embed.hashed(ch), q, embed.hashed(q, "query_id"), k, k, final)


@query(f"WITH {_search_sql(20)} SELECT query_id, chunk_id, text, section, source_id, page, url, parent_id, chunk_index, title, lang, round(rrf_score, 6) AS rrf_score, dense_rank, lexical_rank, final_rank FROM best JOIN ch USING (chunk_id) WHERE final_rank <= 6")
def search_chunks(spark, d):
    return _search(spark, d, 20, 6).withColumn("rrf_score", F.round("rrf_score", 6))


@query(f"WITH {_search_sql(20)} SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS rrf_score FROM (SELECT query_id, chunk_id, rank FROM dense UNION ALL SELECT query_id, chunk_id, rank FROM lex) GROUP BY 1, 2")
def rrf_fuse(spark, d):
    ch, q = stored(spark, d), questions(spark, d)
    a = dense.sparse_topk(embed.hashed(ch), embed.hashed(q, "query_id"), 20).select("query_id", "chunk_id", "rank")
    b = lexical.lexical_topk(ch.where("not is_parent"), q, 20).select("query_id", "chunk_id", "rank")
    return search.rrf(a.union(b)).withColumn("rrf_score", F.round("rrf_score", 6))


GROUPS = [["Sūrya", "Surya", "Sun"], ["Candra", "Chandra", "Moon"], ["Maṅgala", "Mangala", "Mars"], ["Śani", "Shani", "Saturn"], ["Śukra", "Shukra", "Venus"], ["Bṛhaspati", "Jupiter"], ["Vṛṣabha", "Taurus"], ["Siṁha", "Leo"], ["Tulā", "Libra"], ["Kumbha", "Aquarius"]]


_TERMS = list({v.lower(): [x for x in g if x.lower() != v.lower()] for g in GROUPS for v in g}.items())
_LEXICON = "lexi AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', [{', '.join(repr(a) for a in alts)}])" for t, alts in _TERMS) + ") x(term, alts))"


def _variants(questions: str) -> str:
    """CTEs up to ``vars``: query_id, variant_no, text."""
    return rf"""{_LEXICON}, tok AS (SELECT query_id, generate_subscripts(t, 1) AS i, unnest(t) AS tok FROM (SELECT query_id, regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}]+|[^\p{{L}}\p{{M}}\p{{N}}]+') AS t FROM {questions})), st AS (SELECT tok.*, s, alts[s + 1] AS alt FROM tok LEFT JOIN lexi ON term = lower(tok), (SELECT unnest([0, 1, 2]) AS s)),
 made AS (SELECT query_id, s + 1 AS v, string_agg(coalesce(alt, tok), '' ORDER BY i) AS text FROM st GROUP BY query_id, s HAVING count(alt) > 0), ev AS (SELECT query_id, 0 AS v, text FROM {questions} UNION ALL SELECT * FROM made), fst AS (SELECT query_id, text, min(v) AS v FROM ev GROUP BY 1, 2), vars AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY v) - 1 AS variant_no, text FROM fst)"""


_EVERY = QS.replace("WHERE question_id % 50 = 0", "")


def all_questions(spark, d):
    return gold(spark, d).select(F.col("question_id").alias("query_id"), F.col("question").alias("text"))


@query(f"WITH {_EVERY}, {_variants('qs')} SELECT query_id, variant_no, text FROM vars")
def lexicon_rewrite(spark, d):
    return rewrite.rewrite(all_questions(spark, d), "lexicon", rewrite.lexicon(spark, GROUPS))


@query(
    rf"""WITH {CH}, {QS.replace('qs AS', 'q0 AS')}, {_variants('q0')}, qs AS (SELECT query_id || chr(31) || variant_no AS query_id, text FROM vars), {QV}, {CV}, {DENSE.format(k=20)}, {LEX.format(k=20)}, {FUSED},
 ru AS (SELECT split_part(query_id, chr(31), 1)::BIGINT AS query_id, chunk_id, round(sum(1.0 / (60 + final_rank)), 9) AS s FROM best WHERE final_rank <= 40 GROUP BY 1, 2), po AS (SELECT * FROM ru QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) <= 40),
 tm AS (SELECT query_id, chunk_id, ch.text, ch.parent_id, list_distinct(list_filter(regexp_extract_all(lower(q0.text), '[\p{{L}}\p{{N}}]+'), lambda w: w NOT IN ({STOP}))) AS qt, regexp_extract_all(lower(ch.text), '[\p{{L}}\p{{N}}]+') AS tt FROM po JOIN ch USING (chunk_id) JOIN q0 USING (query_id)),
 rr AS (SELECT query_id, chunk_id, text, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY round(len(list_intersect(qt, tt)) / greatest(len(qt), 1), 6) DESC, chunk_id) AS rank FROM tm QUALIFY rank <= 6),
 ex AS (SELECT rr.query_id, rr.chunk_id, coalesce(pa.text, rr.text) AS text, rr.rank, CASE WHEN pa.chunk_id IS NULL THEN rr.chunk_id ELSE rr.parent_id END AS fam FROM rr LEFT JOIN ch pa ON pa.chunk_id = rr.parent_id AND pa.is_parent), o AS (SELECT * FROM ex QUALIFY row_number() OVER (PARTITION BY query_id, fam ORDER BY rank) = 1), c AS (SELECT *, sum(length(text)) OVER w AS c, row_number() OVER w AS n FROM o WINDOW w AS (PARTITION BY query_id ORDER BY rank))
 SELECT query_id, chunk_id, md5(text) AS text, rank FROM c WHERE n = 1 OR c <= 12288"""
)
def retrieve_hits(spark, d):
    """Wordings by the lexicon, search of each, fusion, reranking, parent expansion."""
    ch, q = stored(spark, d), questions(spark, d)
    v = rewrite.rewrite(q, "lexicon", rewrite.lexicon(spark, GROUPS))
    return search.retrieve(ch, embed.hashed(ch), q, v, 20, 20, reranking=True).withColumn("text", F.md5("text"))


_BM25 = rf"""bq AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM qs) WHERE term <> ''), bw AS (SELECT chunk_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM {{src}}), bst AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM bw),
 btf AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM bw) WHERE term IN (SELECT term FROM bq) GROUP BY 1, 2), bdf AS (SELECT term, count(*) AS df FROM btf GROUP BY 1),
 bm AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM btf JOIN bdf USING (term) JOIN bq USING (term), bst GROUP BY 1, 2 QUALIFY rank <= 20)"""


@query(f"WITH {CH}, {QS}, {QV}, {CV}, {DENSE.format(k=20)}, {_BM25.format(src='ch')}, r AS (SELECT query_id, chunk_id, rank FROM dense UNION ALL SELECT query_id, chunk_id, rank FROM bm), f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS s FROM r GROUP BY 1, 2) SELECT query_id, chunk_id, round(s, 6) AS rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM f QUALIFY rank <= 5")
def quick_retrieve(spark, d):
    return search.quick_retrieve(stored(spark, d), questions(spark, d)).withColumn("rrf_score", F.round("rrf_score", 6))


@query(f"WITH {CH}, {QS}, {_BM25.format(src='kids')}, h AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(1.0 / (60 + rank), 9) DESC, chunk_id) AS rank FROM bm QUALIFY rank <= 6) SELECT query_id, chunk_id, md5(ch.text) AS text, h.rank FROM h JOIN ch USING (chunk_id)")
def retrieve_files(spark, d):
    """Retrieval over chunk files without vectors: BM25 alone."""
    return search.retrieve_files(stored(spark, d), questions(spark, d), k_dense=20, k_lexical=20, expand=False).withColumn("text", F.md5("text"))


_PK = "pk AS (SELECT * FROM kids WHERE source_type = 'web')"


@query(f"WITH {CH}, {_PK}, qs AS (SELECT 1 AS query_id, 'Which rule does the moon follow in the ninth house?' AS text), {QV}, {CV.replace('FROM ch', 'FROM kids')}, {DENSE.format(k=60)}, {LEX.format(k=60).replace('FROM kids', 'FROM pk')}, {FUSED.replace('JOIN kids', 'JOIN pk')} SELECT chunk_id, source_id, round(rrf_score, 6) AS rrf_score, dense_rank, lexical_rank FROM best JOIN ch USING (chunk_id) WHERE final_rank <= 8")
def search_function(spark, d):
    """The SQL table function, asked a question about pages of the web."""
    ch = stored(spark, d)
    search.register_search_function(ch, settle(embed.sparse(ch.where("not is_parent")), "sparse"), "search")
    return spark.sql("SELECT chunk_id, source_id, round(cast(rrf_score AS double), 6) AS rrf_score, dense_rank, lexical_rank FROM search_hits('Which rule does the moon follow in the ninth house?', 8, 'web')")


EXPAND_HITS = "h AS (SELECT source_id AS query_id, chunk_id, parent_id, text, row_number() OVER (PARTITION BY source_id ORDER BY chunk_index, chunk_id) AS rank FROM kids)"


@query(
    f"WITH {CH}, {EXPAND_HITS}, p AS (SELECT h.query_id, h.chunk_id, coalesce(ch.text, h.text) AS text, h.rank, CASE WHEN ch.chunk_id IS NULL THEN h.chunk_id ELSE h.parent_id END AS fam FROM h LEFT JOIN ch ON ch.chunk_id = h.parent_id AND ch.is_parent), o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id, fam ORDER BY rank) = 1), r AS (SELECT *, sum(length(text)) OVER w AS c, row_number() OVER w AS n FROM o WINDOW w AS (PARTITION BY query_id ORDER BY rank)) SELECT query_id, chunk_id, md5(text) AS text, rank FROM r WHERE n = 1 OR c <= 6000"
)
def parent_expand(spark, d):
    from pyspark.sql import Window

    ch = latest(spark, d)
    h = ch.where("not is_parent").withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy("chunk_index", "chunk_id"))).select(F.col("source_id").alias("query_id"), "chunk_id", "parent_id", "text", "rank")
    return search.expand_parents(h, ch, 6000).withColumn("text", F.md5("text"))


def _prompt_hits(spark, d):
    return _search(spark, d, 20, 3).withColumnRenamed("final_rank", "rank")


@query(f"WITH {_search_sql(20)}, h AS (SELECT query_id, final_rank, '[' || final_rank || '] ' || ch.text || ' (' || concat_ws(', ', title, section, 'p. ' || page, url) || ')' AS line FROM best JOIN ch USING (chunk_id) WHERE final_rank <= 3), c AS (SELECT query_id, string_agg(line, chr(10) || chr(10) ORDER BY final_rank) AS context FROM h GROUP BY 1) SELECT query_id, md5('Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || qs.text || chr(10) || 'Answer:') AS prompt FROM c JOIN qs USING (query_id)")
def prompt_build(spark, d):
    return faithfulness.prompt(_prompt_hits(spark, d), questions(spark, d)).withColumn("prompt", F.md5("prompt"))


# ---- answers ----

_GSTOP = ", ".join(f"'{w}'" for w in X.GATE_STOPWORDS)
_CW = "list_filter(list_distinct(regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[a-z0-9]+')), lambda x: x NOT IN (" + _GSTOP + "))"


@query(
    f"""WITH {CH}, {QS}, src AS (SELECT question_id, {STRIP.format('answer')} AS answer FROM gold WHERE answer IS NOT NULL), {_sent('question_id', 'answer', 'src')}, t AS (SELECT id, pos, {_CW.format('sentence')} AS w FROM sents WHERE len(regexp_extract_all(replace(lower(sentence), 'ß', 'ss'), '[a-z0-9]+')) >= 6), u AS (SELECT * FROM t WHERE len(w) > 0),
 hits AS (SELECT question_id AS id, unnest(relevant_chunk_ids) AS chunk_id, generate_subscripts(relevant_chunk_ids, 1) AS hit_no FROM gold), ht AS (SELECT hits.id, chunk_id, hit_no, {_CW.format('text')} AS hw FROM hits JOIN ch USING (chunk_id)),
 b AS (SELECT u.id, u.pos, max(coalesce(len(list_intersect(w, hw)) / len(w), 0)) AS share FROM u LEFT JOIN ht ON ht.id = u.id GROUP BY 1, 2), n AS (SELECT id, count(*) AS c, count(*) FILTER (WHERE share < 0.4) AS bad FROM b GROUP BY 1)
 SELECT question_id AS answer_id, coalesce(c, 0) > 0 AND coalesce(bad, 0) = 0 AS ok, coalesce(c, 0) AS n_checked, coalesce(bad, 0) AS n_unsupported FROM src LEFT JOIN n ON n.id = question_id"""
)
def answer_gate(spark, d):
    g = gold(spark, d).where("answer is not null")
    h = g.select("question_id", F.posexplode("relevant_chunk_ids").alias("hit_no", "chunk_id")).join(latest(spark, d).select("chunk_id", "text"), "chunk_id").withColumnRenamed("question_id", "answer_id")
    return faithfulness.check(g.select(F.col("question_id").alias("answer_id"), "answer"), h).select("answer_id", "ok", "n_checked", "n_unsupported")


# ---- evaluation ----


def _golden(spark, d):
    src = F.when(F.exists("source_ids", lambda s: s.startswith("http")), "web").otherwise("pdf")
    return gold(spark, d).where("question_id % 50 = 0").select(F.col("question_id").alias("query_id"), F.coalesce("relevant_chunk_ids", F.array().cast("array<string>")).alias("relevant_chunk_ids"), F.coalesce("stratum", F.lit("unknown")).alias("stratum"), F.coalesce("block_type", F.lit("text")).alias("block_type"), F.coalesce(src, F.lit("pdf")).alias("source_type"))


def _metrics(spark, d, k=20, ch=None):
    return evaluate.per_question(_search(spark, d, k, 2 * k, ch).withColumnRenamed("final_rank", "rank"), _golden(spark, d))


EVAL = (
    "g AS (SELECT question_id AS query_id, list_distinct(coalesce(relevant_chunk_ids, [])) AS rel, coalesce(stratum, 'unknown') AS stratum, coalesce(block_type, 'text') AS block_type, CASE WHEN len(list_filter(source_ids, lambda s: starts_with(s, 'http'))) > 0 THEN 'web' ELSE 'pdf' END AS source_type FROM gold WHERE question_id % 50 = 0), "
    "rk AS (SELECT best.*, list_contains(rel, chunk_id) AS hit, len(rel) AS nr FROM best JOIN g USING (query_id) WHERE final_rank <= 40), "
    "m AS (SELECT query_id, count(*) AS candidates, count(*) FILTER (WHERE hit AND final_rank <= 5) AS h5, count(*) FILTER (WHERE hit AND final_rank <= 10) AS h10, count(*) FILTER (WHERE hit AND final_rank <= 20) AS h20, count(*) FILTER (WHERE hit AND final_rank <= 50) AS h50, min(final_rank) FILTER (WHERE hit) AS fr, coalesce(sum(1 / log2(final_rank + 1)) FILTER (WHERE hit AND final_rank <= 10), 0) AS dcg, count(*) FILTER (WHERE hit AND dense_rank IS NOT NULL) AS dh, count(*) FILTER (WHERE hit AND lexical_rank IS NOT NULL) AS lh FROM rk GROUP BY 1), "
    "pq AS (SELECT g.query_id, stratum, block_type, source_type, coalesce(candidates, 0) AS candidates, CASE WHEN len(rel) > 0 THEN coalesce(h5, 0) / len(rel) ELSE 0 END AS recall_5, CASE WHEN len(rel) > 0 THEN coalesce(h10, 0) / len(rel) ELSE 0 END AS recall_10, CASE WHEN len(rel) > 0 THEN coalesce(h20, 0) / len(rel) ELSE 0 END AS recall_20, CASE WHEN len(rel) > 0 THEN coalesce(h50, 0) / len(rel) ELSE 0 END AS recall_50, CASE WHEN fr <= 10 THEN 1.0 / fr ELSE 0 END AS mrr_10, "
    "CASE WHEN len(rel) > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(len(rel), 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg_10, fr AS first_hit_rank, coalesce(dh, 0) AS dense_leg_hits, coalesce(lh, 0) AS lexical_leg_hits FROM g LEFT JOIN m USING (query_id))"
)
_M = ["recall_5", "recall_10", "recall_20", "recall_50", "mrr_10", "ndcg_10"]


@query(f"WITH {_search_sql(20)}, {EVAL} SELECT query_id, stratum, block_type, source_type, candidates, {', '.join(f'round({m}, 6) AS {m}' for m in _M)}, first_hit_rank, dense_leg_hits, lexical_leg_hits FROM pq")
def eval_metrics(spark, d):
    m = _metrics(spark, d)
    return m.select(*[F.round(c, 6).alias(c) if c in _M else F.col(c) for c in m.columns])


@query(f"WITH {_search_sql(20)}, {EVAL} SELECT CASE grouping(stratum, block_type, source_type) WHEN 7 THEN 'overall' WHEN 3 THEN 'stratum' WHEN 5 THEN 'block_type' ELSE 'source_type' END AS dimension, CASE grouping(stratum, block_type, source_type) WHEN 7 THEN '' WHEN 3 THEN stratum WHEN 5 THEN block_type ELSE source_type END AS segment, count(*) AS n, {', '.join(f'round(avg({m}), 4) AS {m}' for m in _M)}, round(avg(candidates), 1) AS mean_candidates, sum(dense_leg_hits) AS dense_leg_hits, sum(lexical_leg_hits) AS lexical_leg_hits, count(first_hit_rank) AS found_any FROM pq GROUP BY GROUPING SETS ((), (stratum), (block_type), (source_type))")
def eval_report(spark, d):
    return evaluate.report(_metrics(spark, d))


_REPORT = f"SELECT CASE grouping(stratum, block_type, source_type) WHEN 7 THEN 'overall' WHEN 3 THEN 'stratum' WHEN 5 THEN 'block_type' ELSE 'source_type' END AS dimension, CASE grouping(stratum, block_type, source_type) WHEN 7 THEN '' WHEN 3 THEN stratum WHEN 5 THEN block_type ELSE source_type END AS segment, {', '.join(f'round(avg({m}), 4) AS {m}' for m in _M)} FROM pq GROUP BY GROUPING SETS ((), (stratum), (block_type), (source_type))"
_EVAL5 = EVAL.replace("final_rank <= 40", "final_rank <= 10")


@query(f"SELECT n.dimension, n.segment, {', '.join(f'round(n.{m} - b.{m}, 4) AS {m}' for m in _M)} FROM (WITH {_search_sql(20)}, {EVAL} {_REPORT}) n JOIN (WITH {_search_sql(5)}, {_EVAL5} {_REPORT}) b USING (dimension, segment)")
def eval_diff(spark, d):
    ch = stored(spark, d)
    return evaluate.diff(evaluate.report(_metrics(spark, d, 5, ch)), evaluate.report(_metrics(spark, d, 20, ch)))


# ---- making of labelled questions ----

DF = r"df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(lower(text), '\p{L}{3,}')) AS term FROM kids) GROUP BY 1)"


@query(f"WITH {CH}, {DF} SELECT term, df FROM df")
def doc_freq(spark, d):
    return golden.doc_freq(latest(spark, d).where("not is_parent"))


@query(
    rf"""WITH {CH}, {DF}, n AS (SELECT count(*) AS n FROM kids), tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '\p{{L}}{{4,}}')) AS term FROM kids) GROUP BY 1, 2), hd AS (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(lower(coalesce(section, '')), '\p{{L}}{{3,}}')) AS term FROM kids),
 s AS (SELECT tf.chunk_id, tf.term, round(tf * ln(n / df), 6) AS score FROM tf JOIN df USING (term) CROSS JOIN n LEFT JOIN hd ON hd.chunk_id = tf.chunk_id AND hd.term = tf.term WHERE df >= 5 AND df <= 0.25 * n AND tf.term NOT IN ({STOP}) AND (tf >= 2 OR hd.term IS NOT NULL)) SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, term) AS pos, term, score FROM s QUALIFY pos <= 4"""
)
def distinctive_terms(spark, d):
    kids = latest(spark, d).where("not is_parent")
    n = kids.count()
    return golden.distinctive_terms(kids.select("chunk_id", "text", "section"), golden.doc_freq(kids), n)


_BT = "coalesce(CASE WHEN json_valid(extra) THEN json_extract_string(extra, '$.block_type') END, 'text')"
_STRATA = {"numeric": ("table", "", ""), "procedural": ("text", golden.PROCEDURAL, ""), "negation": ("text", golden.NEGATION, ""), **{s: ("text", "", s) for s in ("lookup", "synthesis", "transliteration", "conflict")}}


@query(
    f"WITH {CH}, c AS (SELECT chunk_id, text, {_BT} AS kind FROM kids WHERE length(text) > 400) "
    + " UNION ALL ".join(f"(SELECT '{s}' AS stratum, chunk_id, kind FROM c WHERE kind = '{k}'" + (f" AND regexp_matches(text, '{p}')" if p else "") + f" ORDER BY md5(chunk_id || '{salt}'), chunk_id LIMIT 25)" for s, (k, p, salt) in _STRATA.items())
)
def stratum_samples(spark, d):
    return golden.samples(latest(spark, d), 25).select("stratum", "chunk_id", "kind")


@query(f"WITH {CH}, f AS (SELECT source_id, min_by(chunk_id, md5(chunk_id || 'synthesis') || chunk_id) AS chunk_id FROM kids GROUP BY 1), r AS (SELECT chunk_id, row_number() OVER (ORDER BY md5(source_id || 'synthesis'), source_id) AS rn FROM f) SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b FROM r a JOIN r b ON b.rn = a.rn + 1 WHERE a.rn % 2 = 1")
def source_pairs(spark, d):
    return golden.source_pairs(latest(spark, d).where("not is_parent"))


_NG = r"list_distinct(list_transform(range(1, len({w}) - 3), lambda i: array_to_string({w}[i:i + 4], ' ')))"


@query(
    rf"""WITH {CH}, {QS}, q AS (SELECT question_id AS query_id, unnest(relevant_chunk_ids) AS chunk_id, list_filter(regexp_split_to_array(lower(question || ' ' || coalesce(answer, '')), '\s+'), lambda x: x <> '') AS w FROM gold), c AS (SELECT chunk_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS v FROM ch),
 h AS (SELECT query_id, unnest(list_intersect({_NG.format(w='w')}, {_NG.format(w='v')})) AS g FROM q JOIN c USING (chunk_id) WHERE len(w) >= 5 AND len(v) >= 5) SELECT query_id, count(DISTINCT g) AS n_shared FROM h GROUP BY 1"""
)
def ngram_leaks(spark, d):
    q = gold(spark, d).select(F.col("question_id").alias("query_id"), F.concat_ws(" ", "question", F.coalesce("answer", F.lit(""))).alias("text"), "relevant_chunk_ids")
    return golden.leaks(q, latest(spark, d))


@query(f"WITH {_EVERY}, {_LEXICON}, w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}]+')) AS word FROM qs), a AS (SELECT word, alts, list_sort(list_transform(list_filter(alts, lambda x: regexp_matches(x, '^[\\x00-\\x7f]+$')), lambda x: {{'n': length(x), 'a': x}})) AS s FROM w JOIN lexi ON term = lower(word)) SELECT word, CASE WHEN len(s) > 0 THEN s[1].a ELSE alts[1] END AS alt FROM a")
def lexicon_alternatives(spark, d):
    words = all_questions(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{M}]+)"), 1)).alias("word")).distinct()
    return rewrite.alternative(words, rewrite.lexicon(spark, GROUPS))


@query()
def respelled_questions(spark, d):
    """Every question with its known words in another spelling."""
    return rewrite.respelled(all_questions(spark, d), rewrite.lexicon(spark, GROUPS))


@query()
def golden_build(spark, d):
    """A labelled set of up to ten questions a stratum, made without a model."""
    return golden.build(stored(spark, d), 10, lexicon=rewrite.lexicon(spark, GROUPS)).select("question_id", "question", "stratum", "relevant_chunk_ids", "source_ids", "block_type")


# ---- store ----


@query(f"WITH {CH} SELECT chunk_id, md5(text) AS text FROM ch WHERE chunk_id IN (SELECT unnest(relevant_chunk_ids) FROM golden_rows WHERE question_id = (SELECT min(question_id) FROM golden_rows WHERE len(relevant_chunk_ids) > 0))")
def chunks_by_ids(spark, d):
    one = table(spark, d, "golden_rows").where(F.size("relevant_chunk_ids") > 0).orderBy("question_id").limit(1).collect()
    return store.by_ids(latest(spark, d), one[0]["relevant_chunk_ids"] if one else []).select("chunk_id", F.md5("text").alias("text"))


@query(f"WITH {CH}, {VEC} SELECT chunk_id FROM kids WHERE chunk_id NOT IN (SELECT chunk_id FROM vec)")
def missing_vectors(spark, d):
    return store.missing_vectors(latest(spark, d), vectors(spark, d)).select("chunk_id")


@query(f"WITH {CH}, {VEC} SELECT (SELECT count(*) FROM ch) AS n_chunks, (SELECT count(*) FROM kids) AS n_children, (SELECT count(*) FROM kids WHERE chunk_id NOT IN (SELECT chunk_id FROM vec)) AS n_missing, (SELECT count(*) FROM vec) AS n_vectors")
def store_counts(spark, d):
    return store.counts(latest(spark, d), vectors(spark, d))


@query(f"WITH {CH}, {VEC} SELECT source_type, source_id, count(*) AS n_chunks, count(*) FILTER (WHERE is_parent) AS n_parents, count(vec.chunk_id) AS n_embedded FROM ch LEFT JOIN vec USING (chunk_id) GROUP BY 1, 2")
def source_report(spark, d):
    return store.source_report(latest(spark, d), vectors(spark, d))


@query(f"WITH {CH} SELECT chunk_index, count(*) AS n FROM ch GROUP BY 1")
def index_histogram(spark, d):
    return store.index_histogram(latest(spark, d))


@query(f"WITH {CH}, {VEC} SELECT greatest((SELECT max(created_at) FROM ch), (SELECT max(created_at) FROM vec)) AS watermark, (SELECT count(*) FROM ch) + (SELECT count(*) FROM vec) AS n_rows")
def watermark(spark, d):
    return store.watermark(latest(spark, d), vectors(spark, d))


@query("WITH t AS (SELECT * FROM chunks WHERE substr(md5(chunk_id), 1, 1) < '8' QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at) = 1), s AS (SELECT * FROM chunks WHERE substr(md5(chunk_id), 2, 1) < '8' QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC) = 1) SELECT coalesce(t.chunk_id, s.chunk_id) AS chunk_id, coalesce(s.chunk_index, t.chunk_index, 0) AS chunk_index, md5(coalesce(s.text, t.text)) AS text, CASE WHEN t.chunk_id IS NOT NULL THEN t.created_at ELSE s.created_at END AS created_at FROM t FULL JOIN s ON s.chunk_id = t.chunk_id")
def upsert_merge(spark, d):
    c = table(spark, d, "chunks")
    first = c.where("substr(md5(chunk_id), 1, 1) < '8'").groupBy("chunk_id").agg(F.min(F.struct("created_at", "chunk_index", "text")).alias("m")).select("chunk_id", "m.chunk_index", "m.text", "m.created_at")
    fresh = c.where("substr(md5(chunk_id), 2, 1) < '8'").select("chunk_id", "chunk_index", "text", "created_at")
    return store.upsert(first, fresh, order=["created_at"]).withColumn("text", F.md5("text"))


@query(f"WITH {CH}, {VEC}, g AS (SELECT DISTINCT source_id FROM ch WHERE substr(md5(source_id), 1, 1) < '4') SELECT 'chunk' AS kind, chunk_id FROM ch WHERE source_id NOT IN (SELECT source_id FROM g) UNION ALL SELECT 'vector', chunk_id FROM vec WHERE chunk_id NOT IN (SELECT chunk_id FROM ch WHERE source_id IN (SELECT source_id FROM g))")
def delete_cascade(spark, d):
    ch = latest(spark, d)
    a, b = store.delete_sources(ch, vectors(spark, d), ch.where("substr(md5(source_id), 1, 1) < '4'").select("source_id"))
    return a.select(F.lit("chunk").alias("kind"), "chunk_id").union(b.select(F.lit("vector"), "chunk_id"))


@query(f"WITH {CH} SELECT CASE WHEN is_parent THEN 'parents' WHEN {_BT} = 'table' THEN 'tables' WHEN {_BT} = 'figure' THEN 'figures' ELSE 'prose' END AS kind, source_type, count(*) AS n FROM ch GROUP BY 1, 2")
def kind_split(spark, d):
    return dataset.kinds(latest(spark, d)).groupBy("kind", "source_type").agg(F.count("*").alias("n"))


@query(f"WITH {CH} SELECT chunk_id, 'Based on the documentation, explain: ' || coalesce(section, title, 'the source material') || '.' AS instruction, '' AS input, md5(text) AS output FROM kids")
def sft_rows(spark, d):
    return dataset.instruction_rows(latest(spark, d)).select("chunk_id", "instruction", "input", F.md5("output").alias("output"))


@query(f"WITH {CH}, r AS (SELECT chunk_id, row_number() OVER (ORDER BY md5(chunk_id), chunk_id) AS r, count(*) OVER () AS n FROM kids) SELECT chunk_id, CASE WHEN r <= floor(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM r")
def train_val_split(spark, d):
    return dataset.split(latest(spark, d).where("not is_parent").select("chunk_id"))


@query("WITH f AS (SELECT url AS path, floor(epoch(fetched_at))::BIGINT AS mtime, n_bytes AS size, loaded_at FROM crawl_pages WHERE status = 200) SELECT DISTINCT path, mtime, size FROM f WHERE NOT EXISTS (SELECT 1 FROM f m WHERE m.loaded_at < TIMESTAMP '2024-01-01' AND m.path = f.path AND m.mtime = f.mtime AND m.size = f.size)")
def manifest_changed(spark, d):
    f = table(spark, d, "crawl_pages").where("status = 200").select(F.col("url").alias("path"), F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("us"), F.col("n_bytes").alias("size"), "loaded_at").withColumn("mtime", F.expr("us div 1000000"))
    return manifest.changed(f, f.where("loaded_at < timestamp '2024-01-01'")).select("path", "mtime", "size").distinct()


@query(f"WITH {CH} SELECT chunk_id, {_BT} AS block_type, CASE WHEN json_valid(extra) THEN json_extract_string(extra, '$.backend') END AS backend FROM ch")
def meta_fields(spark, d):
    return latest(spark, d).select("chunk_id", golden.block_type(files.valid_json(F.col("extra"))).alias("block_type"), F.get_json_object(files.valid_json(F.col("extra")), "$.backend").alias("backend"))


def _roundtrip(spark, d, kind):
    import uuid

    path = f"{shared_dir(spark).rstrip('/')}/rt-{uuid.uuid4().hex}.{kind}"
    ch = latest(spark, d)
    (files.write_parquet if kind == "parquet" else files.write_jsonl)(ch, path)
    return files.combine(spark, [path, path + ".missing"]).select("chunk_id", F.md5("text").alias("text"), "page", "is_parent", "token_count", "created_at")


_RT = f"WITH {CH} SELECT chunk_id, md5(text) AS text, page, is_parent, token_count, created_at FROM ch"


@query(_RT)
def parquet_roundtrip(spark, d):
    return _roundtrip(spark, d, "parquet")


@query(_RT.replace("created_at FROM ch", "date_trunc('millisecond', created_at) AS created_at FROM ch"))
def jsonl_roundtrip(spark, d):
    return _roundtrip(spark, d, "jsonl").withColumn("created_at", F.date_trunc("MILLISECOND", "created_at"))

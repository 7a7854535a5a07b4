"""Text expressions. All are built-in expressions but for rare characters (references of pages, marks of other scripts), which go through Arrow."""

from __future__ import annotations

import html as html_library
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations after which a sentence goes on.
ABBREVIATIONS = "[A-Z]|Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|vs|etc|approx|fig|figs|eq|eqs|e\\.g|i\\.e|cf|al|no|vol|pp|ch|sec"
# Words that carry no content in an answer.
GATE_STOPWORDS = "a an the and or of to in on for with from by is are was were be this that it as at if not no yes so".split()
# Titles that name nothing.
PLACEHOLDER_TITLES = ["(anonymous)", "untitled", "unknown"]


#: Two private characters between sentences while they are put together.
_MARK = "\ue0f0\ue0f1"


def py_strip(x: Column) -> Column:
    """Strip every kind of white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def casefold(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def count_tokens(x: Column) -> Column:
    """Tokens of the fallback counter: a quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4).cast("int"))


def truncate_tokens(x: Column, n: int) -> Column:
    return F.substring(x, 1, 4 * n)


def sentences(text: Column) -> Column:
    """Sentences of a text; one that ends in an abbreviation goes on with the next."""
    raw = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9])"), py_strip), lambda s: s != "")
    ends_short = lambda s: s.rlike(rf"(?iU)\b(?:{ABBREVIATIONS})\.$")
    # one pass marks where a sentence ends; what stands between two marks is one sentence
    marked = lambda r: F.array_join(F.transform(r, lambda s: F.concat(s, F.when(ends_short(s), F.lit(" ")).otherwise(F.lit(_MARK)))), "")
    joined = lambda r: F.filter(F.transform(F.split(marked(r), _MARK), F.rtrim), lambda s: s != "")
    # bound in a one-element array, the split text is computed once
    return F.get(F.transform(F.array(raw), lambda r: F.when(F.exists(r, ends_short), joined(r)).otherwise(r)), F.lit(0))


def words(text: Column) -> Column:
    """ASCII words of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def content_words(text: Column) -> Column:
    """Distinct ASCII words of the case-folded text without stop words."""
    found = F.regexp_extract_all(casefold(text), F.lit("([a-z0-9]+)"), 1)
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in GATE_STOPWORDS]))


def unicode_words(text: Column, least: int = 3) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(\p{{L}}{{{least},}})"), 1)


def blank_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def ngrams(tokens: Column, n: int = 5) -> Column:
    """Distinct runs of n words, joined by blanks."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def condense(text: Column, n: int = 600) -> Column:
    return F.substring(py_strip(F.regexp_replace(text, r"(?U)\s+", " ")), 1, n)


def clean_heading(line: Column) -> Column:
    """Text of a heading line without emphasis marks."""
    return F.trim(F.regexp_replace(line, r"[*_`#]+", ""))


def heading_level(line: Column) -> Column:
    """1 to 6 for a markdown heading line, else 0."""
    return F.length(F.regexp_extract(py_strip(line), r"^(#{1,6})\s+.*$", 1))


def line_key(line: Column) -> Column:
    return casefold(F.regexp_replace(py_strip(line), r"(?U)\s+", " "))


def real_title(title: Column) -> Column:
    t = py_strip(title)
    return F.when((t == "") | F.lower(t).isin(PLACEHOLDER_TITLES), F.lit(None).cast("string")).otherwise(t)


def with_heading(heading: Column, body: Column) -> Column:
    """The body behind its heading, unless it opens with it."""
    return F.when(heading.isNull() | (heading == "") | F.startswith(F.ltrim(body), heading), body).otherwise(F.concat(heading, F.lit("\n\n"), body))


# Elements whose content is no text, and what stands for a tag in the text.
OPAQUE = ["script", "style", "noscript", "svg"]
LINE_BREAK, PARAGRAPH = ["br"], ["p", "h1", "h2", "h3", "h4", "h5", "h6"]
#: A page's tokens: an element without text from its first tag to its last, a comment, a tag, a run of text.
_TOKEN = "(?is)(" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in OPAQUE) + r"|<!--.*?-->|<[^>]+>|[^<]+|<)"


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else html_library.unescape(t) for t in texts], dtype=object)


def unescape(text: Column) -> Column:
    """Character references, named and numeric. Texts with the five basic ones alone stay in the JVM."""
    basic = text
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        basic = F.replace(basic, F.lit(f"&{name};"), F.lit(char))
    other = text.rlike("&(?!(?:lt|gt|quot|apos|amp);)(?:#|[A-Za-z])")
    return F.when(other, _unescaped(F.when(other, text))).otherwise(basic)


def html_text(html: Column, main_text: Callable[[str], str | None] | None = None) -> Column:
    """Text of a page: tokens are classified one by one; what is no text becomes a blank, line breaks and ends of paragraphs and headings
    become line ends. ``main_text`` is a hook that finds the main text of a page; where it gives none, the page's whole text is taken."""
    name = lambda t: F.lower(F.regexp_extract(t, r"^<\s*(/?[A-Za-z][A-Za-z0-9]*)", 1))
    said = lambda t: (
        F.when(~F.startswith(t, F.lit("<")) | (t == "<"), t)
        .when(name(t).isin(LINE_BREAK), F.lit("\n"))
        .when(name(t).isin([f"/{x}" for x in PARAGRAPH]), F.lit("\n\n"))
        .otherwise(F.lit(" "))
    )
    flat = unescape(F.array_join(F.transform(F.regexp_extract_all(html, F.lit(_TOKEN), 1), said), ""))
    whole = py_strip(F.regexp_replace(F.regexp_replace(flat, r"[ \t]+", " "), r"\n{3,}", "\n\n"))
    if main_text is None:
        return whole

    @F.pandas_udf(T.StringType())
    def found(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) if x else None for x in pages], dtype=object)

    main = py_strip(found(html))
    return F.when(F.length(main) > 0, main).otherwise(whole)


def html_title(html: Column) -> Column:
    inner = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)
    return F.nullif(py_strip(unescape(F.regexp_replace(inner, r"\s+", " "))), F.lit(""))


def fold_diacritics(text: Column) -> Column:
    """Letters without their marks, in lower case. Composed Latin letters stay in the JVM; other texts go through Arrow."""
    return F.when(text.rlike(_PLAIN_LATIN), F.translate(F.lower(text), *_COMPOSED)).otherwise(_folded(F.when(~text.rlike(_PLAIN_LATIN), text)))


def _composed() -> tuple[str, str]:
    """By rule: letters that decompose into an ASCII letter and marks."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))[0]) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if chr(i).islower()]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_COMPOSED = _composed()
_PLAIN_LATIN = "^[\\x00-\\x7f" + _COMPOSED[0] + "".join(c.upper() for c in _COMPOSED[0] if len(c.upper()) == 1) + "]*$"


@F.pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c)) for t in texts], dtype=object)


def keep_figure_text(text: Column, least: int = 40, letters: float = 0.35) -> Column:
    """OCR text worth keeping: long enough and mostly letters."""
    t = py_strip(text)
    return (F.length(t) >= least) & (F.regexp_count(t, F.lit(r"\p{L}")) >= F.length(t) * letters)


def table_rows(table: Column) -> Column:
    """Lines of a markdown table that hold a value."""
    lines = F.filter(F.split(table, "\n"), lambda x: x.rlike(r"^\s*\|") & ~x.rlike(r"^\s*\|[\s|:-]*$"))
    return F.filter(lines, lambda x: F.regexp_replace(x, r"[|\s]", "") != "")


def markdown_table(cells: Column) -> Column:
    """A markdown table of an array of rows of cells; the first row is the head."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))), " | "), F.lit(" |"))
    body = F.transform(cells, row)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.get(cells, F.lit(0)))))
    return F.when(F.size(cells) > 0, F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, F.greatest(F.size(cells), F.lit(1)))), "\n"))

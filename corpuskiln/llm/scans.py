"""Problem 6: noise of the printed page and of the recognition in texts of scanned documents.

Method: edge lines (running titles and page numbers) are found by their form, by the document's title
and by the layout, and removed; words divided at a line end are joined where the joined form has the
evidence of the corpus; words with misrecognised characters are found by anagram hashing in SQL: the
hash of a word is the sum of its characters' values, so replacing one confusable part by another adds a
fixed difference, and rare words meet the frequent words they may stand for in an equi-join. Ranked
corrections (fewest replacements, then the most frequent word) are applied to the text.

Words are counted over all texts. Only scanned documents are analysed; their words and the frequent
words are joined, broadcast only when counted small.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, settle, ship
from .lookalike import map_look

# What is printed and what the recognition makes of it.
CONFUSIONS = [
    ("a", "@"), ("b", "6"), ("c", "e"), ("d", "cl"), ("e", "c"), ("g", "9"), ("h", "li"), ("i", "l"), ("in", "m"), ("l", "1"), ("l", "i"),
    ("m", "rn"), ("n", "ri"), ("o", "0"), ("s", "5"), ("s", "$"), ("t", "f"), ("u", "ii"), ("w", "vv"),
]
#: A frequent word stands at least so often in the corpus, and so many times as often as its variant.
FREQUENT, RATIO = 10, 20
#: Words with a misrecognised character a text needs to count as misread: of the four asked for one may be a name that the corpus does
#: not know, so three sure ones stand for four.
SURE = 3
#: Texts that one task parses.
UNITS = 4000
HYPHENS = "-‐¬­‑"
_EDGES = ".,;:!?()\"'।॥“”„«»[]|’‘*_#…–—<>{}"
_NUMBER = re.compile(r"^\W{0,4}(?:p|pp|pag|page|pg|s|seite|página|pagina|पृष्ठ)?\.?\s*(?:[0-9०-९]{1,3}|[ivxlcdm]{1,8})\W{0,4}$", re.I)
_AROUND = re.compile(r"^\W*(?:[0-9०-९]{1,5}|[ivxlcdm]{1,8}(?=\s))?\W*(.*?)\W*(?:\s[0-9०-९]{1,5}|\s[ivxlcdm]{1,8})?\W*$", re.I | re.S)
_STOP = re.compile(r"[.!?।॥,;:][\"'”’»)\]]*$")


def letters(line: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFC", line).lower() if unicodedata.category(c)[0] in "LM")


def _width(lines: list[str], i: int, gone: list[int]) -> int:
    """How wide the prose around line i is set: the lesser of the widest of two lines before and of two after."""
    sides = []
    for side in (range(i - 1, -1, -1), range(i + 1, len(lines))):
        near = [len(lines[k].strip()) for k in side if len(lines[k].strip()) > 24 and k not in gone and not lines[k].startswith("|")][:2]
        if near:
            sides.append(max(near))
    return min(sides, default=0)


def furniture(text: str, title: str | None, heading: str | None) -> list[int]:
    """Numbers of the lines that are running titles or page numbers. A heading that opens the text, before a blank line or alone, is none."""
    lines = text.split("\n")
    own = {letters(x) for x in (title, title.split()[-1] if title and title.split() else None, heading) if x}
    out: list[int] = []
    for i, raw in enumerate(lines):
        line = raw.strip()
        if not line or line.startswith("|"):
            continue
        width = _width(lines, i, out)
        follows = lines[i + 1].split()[:1] if i + 1 < len(lines) else []
        before = any(x.strip() and k not in out for k, x in enumerate(lines[:i]))
        blank_next = i + 1 >= len(lines) or not lines[i + 1].strip()
        if not before and blank_next and not line.isupper() and not _NUMBER.match(line) and letters(line) == letters(heading or line) and line[-1:].isalnum() and "   " not in raw.strip():
            continue
        prior = next((x.strip() for k, x in reversed(list(enumerate(lines[:i]))) if x.strip() and k not in out), "")
        if _NUMBER.match(line):
            if ")" in line and "(" not in line:
                continue
            if line.endswith(".") and not line.startswith(("(", "[")) and prior and not _STOP.search(prior) and prior[-1] not in HYPHENS and blank_next and i and lines[i - 1].strip():
                continue  # a sentence that ends in a number
            if len(lines) > 1 and not (line.isalpha() and line.lower() in ("i", "mi", "di", "mix", "dix", "vi", "il", "li", "mil") and not line.islower()):
                out.append(i)
            continue
        if len(lines) == 1:
            continue
        core = _AROUND.match(line)
        name = (core.group(1) if core else line).strip()
        key = letters(name)
        if len(key) < 3 or _STOP.search(line) and not name.isupper():
            continue
        cased = [c for c in name if c.isupper() or c.islower()]
        caps = len(cased) >= 3 and all(c.isupper() for c in cased)
        numbered = name != line.strip() and any(c.isdigit() for c in line)
        opens = i == 0 and letters(line) == letters(heading or "")
        titled = not opens and (key in own and (i > 0 or not blank_next or numbered) or letters(line) in own and (i > 0 or not blank_next))
        # a wrapped line is full: with the next word it would not fit; a short one in mid-sentence or apart from the prose is none of it
        room = len(line) + 1 + (sum(map(len, follows)) or 8) < 0.8 * width
        inside = not _STOP.search(prior) if prior else i > 0
        short = i > 0 and room and len(line) < 48 and len(line.split()) <= 8 and name[:1].isupper() and (inside or blank_next) and line[-1] not in HYPHENS and not line.startswith("Fig")
        first = i == 0 and room and not blank_next and len(line) < 48 and numbered
        if caps or titled or short or first:
            out.append(i)
    return out


_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_] {1,4}){4,}[^\W\d_](?!\S)")
_CAPITALS = re.compile(r"(?<!\S)(?:[0-9]{1,3} +)?[^\W\d_]{2,}(?: +[^\W\d_]{1,})+(?: +[0-9]{1,3})?(?!\S)")


def inline(line: str, title: str | None) -> list[tuple[int, int]]:
    """Where a running title stands within a line of a text that lost its line ends: letters set apart, words in capitals, or the title with a page number."""
    out = [m.span() for m in _SPACED.finditer(line) if m.group(0).replace(" ", "").isupper()]
    if sum(c.isupper() for c in line) > 7:
        run: list[int] = []
        for m in [*re.finditer(r"\S+", line), None]:
            if m and len(m.group(0)) > 1 and m.group(0).isalpha() and m.group(0).isupper():
                run = [run[0] if run else m.start(), m.end()]
            elif run:
                if run[1] - run[0] >= 9 and " " in line[run[0] : run[1]]:
                    out.append((run[0], run[1]))
                run = []
    if title and len(title) > 5 and title in line:
        out += [m.span() for m in re.finditer(r"(?<!\S)(?:[0-9]{1,3} +)?" + re.escape(title) + r"(?: +[0-9]{1,3})?(?!\S)", line)]
    return sorted(set(out))


def unwrapped(text: str, gone: list[int], title: str | None = None) -> tuple[str, list[tuple[str, str]]]:
    """The text without the lines ``gone``, divided words joined and lines flowing; and (joined, hyphenated) of each divided word."""
    drop = set(gone)
    kept = [x for i, x in enumerate(text.split("\n")) if i not in drop]
    for k, x in enumerate(kept):
        for lo, hi in reversed(inline(x, title)) if not x.startswith("|") else ():
            kept[k] = f"{x[:lo].rstrip()} {x[hi:].lstrip()}".strip()
            x = kept[k]
    out, breaks = "", []
    flowing = False
    for line in kept:
        s = line.strip()
        if not s and flowing and len(out) > 1 and out[-1] in HYPHENS and _letter(out[-2]):
            continue  # a word divided at the end of a page
        if not s or s.startswith("|"):
            if out and not out.endswith("\n"):
                out += "\n" if s else "\n\n"
            out += s + ("\n" if s else "")
            flowing = False
            continue
        if flowing and len(out) > 1 and out[-1] in HYPHENS and _letter(out[-2]) and _letter(s[0]) and not s[0].isupper():
            left = re.search(r"[^\W\d_][^\s]*$", out[:-1])
            right = re.match(r"[^\s]*", s)
            a, b = (left.group(0) if left else "").lower(), right.group(0).rstrip(_EDGES).lower()
            breaks.append((a.lstrip(_EDGES) + b, f"{a.lstrip(_EDGES)}-{b}"))
            out = out[:-1] + s
        elif flowing and out:
            out += " " + s
        else:
            out += s
        flowing = True
    return out.strip("\n"), breaks


def _letter(c: str) -> bool:
    return unicodedata.category(c)[0] in "LM"


def words_of(text: str) -> list[str]:
    """Lower-case words without punctuation around them; elided articles stand alone."""
    return [x for w in text.lower().replace("’", "'").split() for y in w.split("'") if (x := y.strip(_EDGES))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw: Counter = Counter()

    def flush() -> pa.RecordBatch:
        c: Counter = Counter()
        for w, n in raw.items():
            for x in words_of(w):
                c[x] += n
        raw.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    for b in batches:
        for t in b.column(0).to_pylist():
            raw.update(t.lower().split())
        if len(raw) > 400_000:
            yield flush()
    if raw:
        yield flush()


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` over the texts of the first column, nulls left out; each task counts before the shuffle."""
    c = texts.columns[0]
    return texts.where(F.col(c).isNotNull()).mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


_PARTS = "record_type string, record_id string, furniture array<int>, joined array<string>, hyphenated array<string>, flowing string, words array<string>"


def _analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for title, heading, text in zip(*(b.column(k).to_pylist() for k in (2, 3, 4))):
            text = map_look_lines(text)
            gone = furniture(text, title, heading)
            flow, breaks = unwrapped(text, gone, title)
            within = [i for i, x in enumerate(text.split("\n")) if i not in gone and not x.startswith("|") and x.strip() != (heading or "") and inline(x, title)]
            rows.append((sorted([*gone, *within]), [x for x, _ in breaks], [y for _, y in breaks], flow, words_of(flow)))
        cols = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["record_type", "record_id", "furniture", "joined", "hyphenated", "flowing", "words"])


def map_look_lines(text: str) -> str:
    """Look-alikes mapped line by line, so that the blanks around a line, its only layout, stay in place."""
    return "\n".join(map_look(x) if not x.isascii() or "\r" in x or "\t" in x else x for x in text.replace("­\n", "-\n").split("\n"))


def analyse(units: DataFrame) -> DataFrame:
    """One row per unit (``record_type, record_id, title, heading, text``): its furniture lines, divided words, flowing text and words.

    Null texts get no row; repeated units count once (of several texts under one id, the smallest).
    """
    ship(units.sparkSession)
    one = units.where("text is not null and record_id is not null").groupBy("record_type", "record_id").agg(F.min(F.struct("text", "title", "heading")).alias("u"))
    # dealt out by number, to all cores at least: the shuffle before is small in bytes, the parsing behind it is not
    parts = max(2 * units.sparkSession.sparkContext.defaultParallelism, -(-units.count() // UNITS))
    return one.repartition(parts).select("record_type", "record_id", "u.title", "u.heading", "u.text").mapInArrow(_analyse, _PARTS)


def _value(word):
    """The anagram value: a sum over characters, the same for any order of them."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda a, c: a + F.when(c == "", 0).otherwise(F.xxhash64(c).bitwiseAND(F.lit((1 << 47) - 1))))


#: Words of fewer characters have no place for three confusions.
LONG = 6


def _plain(word):
    """A word with every confusable part written one way, so that a word and what the recognition made of it are the same."""
    for good, bad in sorted(CONFUSIONS, key=lambda c: -len(c[1])):
        if len(bad) > 1 or bad in "@69105$":
            word = F.replace(word, F.lit(bad), F.lit(good))
    word = F.replace(word, F.lit("in"), F.lit("m"))
    return F.translate(word, "eif", "clt")


def _undo(word: str, good: str, bad: str) -> set[str]:
    out, at = set(), word.find(bad)
    while at >= 0:
        out.add(word[:at] + good + word[at + len(bad) :])
        at = word.find(bad, at + 1)
    return out


@F.pandas_udf(T.BooleanType())
def _reaches(rare: pd.Series, word: pd.Series, first: pd.Series, second: pd.Series) -> pd.Series:
    def one(r: str, w: str, i: int, j: int) -> bool:
        once = _undo(r, *CONFUSIONS[i])
        return w in once if j < 0 else any(w in _undo(x, *CONFUSIONS[j]) for x in once) or any(w in _undo(x, *CONFUSIONS[i]) for x in _undo(r, *CONFUSIONS[j]))

    return pd.Series([one(*x) for x in zip(rare, word, first, second)], dtype=bool)


def corrections(words: DataFrame, counts: DataFrame) -> DataFrame:
    """``word, correct, n_replaced`` of each word that is far rarer than a frequent word it becomes by undoing confusions.

    ``words`` has the words to judge, ``counts`` the words of the whole corpus with their counts. One or two confusions are undone by
    the difference of the anagram values; words with more of them, however many, meet frequent words on the value of their plain form,
    in which every confusable part is written one way (``n_replaced`` is then the edit distance, 3 at least). Of several frequent words
    the one of fewest replacements, then the most frequent, then the first in order is taken.
    """
    spark = words.sparkSession
    ship(spark)
    frequent = settle(counts.where((F.col("n") >= FREQUENT) & (F.length("word") >= 3) & ~F.col("word").rlike(r"[@$0-9]")).select(F.col("word").alias("correct"), F.col("n").alias("n_correct"), _value(F.col("word")).alias("value"), _plain(F.col("word")).alias("plain")), "scan-frequent")
    own = words.select("word").distinct().where((F.length("word") >= 3) & ~F.col("word").rlike(r"^[\W\d_]*$")).join(counts, "word", "left").select("word", F.coalesce("n", F.lit(1)).alias("n"))
    confusions = [(k, good, bad) for k, (good, bad) in enumerate(CONFUSIONS)]
    held = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(good).alias("good"), F.lit(bad).alias("bad")) for k, good, bad in confusions]), lambda c: F.contains(F.col("word"), c["bad"]))
    single = own.withColumn("held", held).where(F.size("held") > 0).withColumn("a", F.explode("held"))
    tries = single.withColumn("b", F.explode_outer(F.filter("held", lambda c: c["k"] >= F.col("a.k"))))
    step = lambda c: _value(F.col(f"{c}.good")) - _value(F.col(f"{c}.bad"))
    base = tries.select("word", "n", F.col("a.k").alias("first"), F.col("b.k").alias("second"), (_value(F.col("word")) + step("a")).alias("one"), step("b").alias("two"))
    once = base.where("first = second").select("word", "n", "first", F.lit(-1).alias("second"), F.col("one").alias("value"))
    twice = base.select("word", "n", "first", "second", (F.col("one") + F.col("two")).alias("value"))
    hits = once.union(twice).join(broadcast_if_small(frequent, 120), "value").where((F.col("n_correct") >= RATIO * F.col("n")) & (F.col("word") != F.col("correct")))
    good = hits.where(_reaches("word", "correct", "first", "second")).withColumn("n_replaced", F.when(F.col("second") < 0, 1).otherwise(2))
    hard = own.where(F.length("word") >= LONG).withColumn("plain", _plain(F.col("word"))).join(broadcast_if_small(frequent.where(F.length("correct") >= LONG), 120), "plain")
    hard = hard.where((F.col("n_correct") >= RATIO * F.col("n")) & (F.levenshtein("word", "correct") >= 3)).withColumn("n_replaced", F.levenshtein("word", "correct"))
    good = good.select("word", "correct", "n_correct", "n_replaced").union(hard.select("word", "correct", "n_correct", "n_replaced"))
    best = good.groupBy("word").agg(F.min(F.struct("n_replaced", (-F.col("n_correct")).alias("m"), "correct")).alias("b"))
    return best.select("word", "b.correct", "b.n_replaced")


def is_symbol_word(word):
    """A word with digits or signs among its letters, ordinals aside."""
    return word.rlike(r"[\p{L}\p{M}][@$0-9]+[\p{L}\p{M}]|^[@$][\p{L}]|^[0-9][\p{L}]{4,}$|[\p{L}\p{M}]{3,}[@$0-9]$") & ~word.rlike(r"^[0-9]+[\p{L}\p{M}]{1,3}$") & ~word.rlike(r"[/\\:.=_-]")


def noise_parts(units: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(parts, counts, fixes)``: the analysed units, the corpus's word counts, and corrections of the units' words."""
    parts = settle(analyse(units), "scan-parts")
    counts = settle(word_counts(corpus), "scan-words")
    fixes = settle(corrections(parts.select(F.explode("words").alias("word")), counts), "scan-fixes")
    return parts, counts, fixes


def found(units: DataFrame, corpus: DataFrame) -> DataFrame:
    """``record_type, record_id, noise`` with a row for each kind: hyphen_break, misread, page_furniture."""
    parts, counts, fixes = noise_parts(units, corpus)
    key = ["record_type", "record_id"]
    edge = parts.where(F.size("furniture") > 0).select(*key, F.lit("page_furniture").alias("noise"))
    breaks = parts.select(*key, F.explode(F.arrays_zip("joined", "hyphenated")).alias("b")).select(*key, F.col("b.joined").alias("joined"), F.col("b.hyphenated").alias("hyphenated"))
    forms = breaks.join(counts.toDF("joined", "n_joined"), "joined", "left").join(counts.toDF("hyphenated", "n_hyphenated"), "hyphenated", "left")
    # a compound that the corpus knows with its hyphen and not without is no divided word
    divided = forms.where(~((F.coalesce("n_hyphenated", F.lit(0)) > 1) & (F.coalesce("n_joined", F.lit(0)) == 0))).select(*key, F.lit("hyphen_break").alias("noise")).distinct()
    said = parts.select(*key, F.explode("words").alias("word"))
    bad = said.join(broadcast_if_small(fixes.select("word", F.lit(True).alias("fixed")), 40), "word", "left").where(F.col("fixed") | is_symbol_word(F.col("word")))
    misread = bad.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= SURE).select(*key, F.lit("misread").alias("noise"))
    return edge.union(divided).union(misread)


@F.pandas_udf(T.StringType())
def _apply(flowing: pd.Series, wrong: pd.Series, right: pd.Series) -> pd.Series:
    def one(text: str | None, a, b) -> str | None:
        if text is None or a is None or not len(a):
            return text
        to = dict(zip(a, b))

        def put(m: re.Match) -> str:
            w = m.group(0)
            x = to.get(w.lower())
            return w if x is None else x.upper() if w.isupper() and len(w) > 1 else x[0].upper() + x[1:] if w[0].isupper() or w[0] in "$5" and m.start() and text[m.start() - 2 : m.start()].rstrip()[-1:] in ".!?" else x

        return re.sub(r"[^\s" + re.escape(_EDGES) + r"]+", put, text)

    return pd.Series([one(*x) for x in zip(flowing, wrong, right)], dtype=object)


def repaired(units: DataFrame, corpus: DataFrame) -> DataFrame:
    """``record_type, record_id, text, n_lines_removed, n_joined, n_corrected``: flowing paragraphs without the noise.

    Empty texts stay empty; a text of furniture only becomes empty.
    """
    parts, _, fixes = noise_parts(units, corpus)
    key = ["record_type", "record_id"]
    own = parts.select(*key, F.explode(F.array_distinct("words")).alias("word")).join(broadcast_if_small(fixes, 60), "word").groupBy(*key).agg(F.collect_list("word").alias("wrong"), F.collect_list("correct").alias("right"))
    return parts.join(own, key, "left").select(*key, _apply("flowing", "wrong", "right").alias("text"), F.size("furniture").alias("n_lines_removed"), F.size("joined").alias("n_joined"), F.coalesce(F.size("wrong"), F.lit(0)).alias("n_corrected"))

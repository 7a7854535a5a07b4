"""Problem 4: one form for texts that look the same.

Method: map look-alike characters, group the mapped values under an accent- and case-sensitive
Unicode collation, take a canonical member of each class by rule and join it back. The collation
ignores characters without any width (format and control characters, whatever their code point) and
keeps accents, case and digits apart; the mapping covers what it keeps apart although it looks alike:
letters of other scripts, styled and full-width forms, ligatures, kinds of blanks, and accents in
decomposed form (Spark's collation keys are taken without decomposition). Small capitals, circled
letters, the dotless i and the long s are seen by a reader and stay.

The canonical member of a class is the one with the fewest characters that the mapping had to change,
then the form most members have, then the smallest hash of the text, then the smallest id.

A class is keyed by two hashes (96 bits) of the collation key, so rows of a class meet without
shuffling any text, and the aggregation by class is partial before its shuffle. The key is taken by
Catalyst's ``CollationKey``: ``xxhash64`` and ``hash`` of a collated string see its raw characters.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle, ship

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = ("аеорсухіѕјԁһԛԝӏАВЕЅІЈКМНОРСТХУԌԚԜӀ", "aeopcyxisjdhqwlABESIJKMHOPCTXYGQWI")
GREEK = ("οναρΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ", "ovapABEZHIKMNOPTYXcj")
ARMENIAN = ("օոսհցՕՍԼ", "onuhgOUL")
CHEROKEE = ("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEHJKLMPRSTVWZ")
#: Letters of the phonetic alphabet drawn as plain ones.
PHONETIC = ("ɑɡ", "ag")
#: Hyphens and apostrophes drawn alike.
PUNCTUATION = ("‐‑’ʼ＇", "--'''")


def _blanks() -> str:
    return "".join(chr(i) for i in range(0x3001) if unicodedata.category(chr(i)) == "Zs" and i != 32)


def _invisible() -> str:
    """Format characters without width; left out are direction marks of scripts that need them drawn."""
    keep = {0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x8E2}
    fmt = [i for i in (*range(0x20000), *range(0xE0000, 0xE0200)) if unicodedata.category(chr(i)) == "Cf" and i not in keep]
    return "".join(chr(i) for i in [*fmt, 0x34F, 0x180B, 0x180C, 0x180D, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)])


def _styled() -> dict[str, str]:
    """By rule: letters and digits in another font or width, Latin ligatures and Roman numerals, as the plain characters they are made of."""
    out = {}
    for i in range(0x80, 0x20000):
        kind = unicodedata.decomposition(chr(i)).partition(">")[0]
        name = unicodedata.name(chr(i), "") if kind == "<compat" else ""
        if kind in ("<font", "<wide", "<narrow") or name.startswith(("LATIN SMALL LIGATURE", "LATIN CAPITAL LIGATURE", "ROMAN NUMERAL", "SMALL ROMAN NUMERAL")):
            out[chr(i)] = unicodedata.normalize("NFKC", chr(i))
    return out


def _foreign_digits() -> tuple[str, str]:
    """Digits of other scripts have the collation weight of ASCII digits, but a reader tells them apart: private code points keep them so under the collation."""
    own = [chr(i) for i in range(128, 0xFF00) if unicodedata.category(chr(i)) == "Nd" and not unicodedata.decomposition(chr(i))]
    return "".join(own), "".join(chr(0xE000 + k) for k in range(len(own)))


def _mapping() -> dict[str, str]:
    letters = "".join(x[0] for x in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, PHONETIC, PUNCTUATION)), "".join(x[1] for x in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, PHONETIC, PUNCTUATION))
    assert len(letters[0]) == len(letters[1])
    out = dict(zip(*letters)) | dict.fromkeys(_blanks(), " ") | dict.fromkeys(_invisible(), "")
    return {c: "".join(out.get(x, x) for x in to) for c, to in _styled().items()} | out


_MAP = _mapping()
_TABLE = str.maketrans(_MAP)
#: Characters that may be mapped: those of the first plane, and all beyond it.
_SUSPECT = re.compile("[" + re.escape("".join(c for c in _MAP if c < "\U00010000")) + "\U00010000-\U0010ffff]")
_CONTROL = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f]")
_BLANKS = re.compile("[ \t\r]+")


def map_look(text: str) -> str:
    """``text`` with look-alikes mapped, invisible characters dropped and runs of blanks made one. A line feed stays: it is seen."""
    if not text.isascii():
        if _SUSPECT.search(text):
            text = text.replace("\u00ad\n", "-\n").translate(_TABLE)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
    if "  " in text or "\t" in text or "\r" in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ":
        text = _BLANKS.sub(" ", text).replace(" \n", "\n").replace("\n ", "\n").strip(" ")
    return text


@F.pandas_udf(T.StringType())
def _changed(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        m = map_look(t)
        return m if m != t else None

    return pd.Series([one(t) for t in texts], dtype=object)


@F.pandas_udf(T.IntegerType())
def _count_changed(texts: pd.Series) -> pd.Series:
    return pd.Series([0 if t is None else sum(c in _MAP for c in _SUSPECT.findall(t)) + len(_CONTROL.findall(t)) + (not unicodedata.is_normalized("NFC", t)) for t in texts], dtype="int32")


#: A text without any of these is its own mapped form: what is neither ASCII, a composed Latin nor a Devanagari letter, and blanks in runs or at ends of lines.
_DOUBT = r"[^\x20-\x7e\n\u00a1-\u00ac\u00ae-\u0131\u0134-\u01bf\u0901-\u093b\u093d-\u0957\u0960-\u0965\u0970-\u097f\u201c\u201d\u2013\u2014\u2026]|  | \n|\n |^ | \z"


def _doubtful(text: Column) -> Column:
    """The text, null where it surely is its own mapped form, so that only the others travel to Python."""
    return F.when(text.rlike(_DOUBT), text)


def mapped(text: Column) -> Column:
    """``text`` with look-alikes mapped; null stays null. Only texts that change come back from Python."""
    return F.coalesce(_changed(_doubtful(text)), text)


def collation_key(text: Column) -> Column:
    """The bytes by which Spark compares ``text`` under the ``UNICODE`` collation, as its joins on collated strings use them."""
    own, private = _foreign_digits()
    text = F.when(text.rlike(r"[\p{Nd}&&[^0-9]]"), F.translate(text, own, private)).otherwise(text)
    jvm = SparkContext._active_spark_context._jvm
    expressions = jvm.org.apache.spark.sql.classic.ExpressionUtils
    return Column(expressions.column(jvm.org.apache.spark.sql.catalyst.expressions.CollationKey(expressions.expression(F.collate(text, "UNICODE")._jc))))


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def look_classes(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """One row per id: ``id, look_a, look_b, text_hash``; the class is (look_a, look_b).

    Null texts are left out (they look like nothing); repeated ids count once (with several texts under one id
    the smallest text hash counts). Empty texts form one class of equal texts. Other columns are ignored.
    """
    ship(df.sparkSession)
    rows = _texts(df, id_col, text_col).select("id", F.xxhash64("text").alias("text_hash"), collation_key(mapped(F.col("text"))).alias("look"))
    rows = rows.select("id", "text_hash", F.xxhash64("look").alias("look_a"), F.hash("look").alias("look_b"))
    return rows.groupBy("id").agg(F.min(F.struct("text_hash", "look_a", "look_b")).alias("m")).select("id", "m.look_a", "m.look_b", "m.text_hash")


def canonical_members(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """One row per id: ``id, canonical_id, class_size, n_forms``.

    The canonical member follows the rule above; ``n_forms`` counts different character strings of the class. Class sizes and
    canonical ids are partial aggregates over (class, form), so a class holding a third of all rows sends one row per task; joining
    them back is skew-safe as the class side has one row per class.
    """
    return _members(df, id_col, text_col)[1].select("id", "canonical_id", "class_size", "n_forms")


def _members(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    ship(df.sparkSession)
    texts = _texts(df, id_col, text_col)
    key = collation_key(mapped(F.col("text")))
    rows = texts.select("id", F.xxhash64("text").alias("text_hash"), _count_changed(_doubtful(F.col("text"))).alias("strange"), key.alias("look"))
    rows = rows.select("id", "text_hash", F.coalesce("strange", F.lit(0)).alias("strange"), F.xxhash64("look").alias("look_a"), F.hash("look").alias("look_b"))
    rows = settle(rows.groupBy("id").agg(F.min(F.struct("text_hash", "strange", "look_a", "look_b")).alias("m")).select("id", "m.*"), "look")
    forms = rows.groupBy("look_a", "look_b", "text_hash", "strange").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    best = F.min(F.struct("strange", (-F.col("n")).alias("rare"), "text_hash", "first"))
    classes = forms.groupBy("look_a", "look_b").agg(best.alias("b"), F.sum("n").alias("class_size"), F.count("*").alias("n_forms"))
    classes = classes.select("look_a", "look_b", F.col("b.first").alias("canonical_id"), F.col("b.text_hash").alias("canonical_hash"), "class_size", "n_forms")
    return texts, rows.join(classes, ["look_a", "look_b"]).select("id", "text_hash", "canonical_id", "canonical_hash", "class_size", "n_forms")


def canonical_text(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """One row per id: ``id, canonical_id, text``; ``text`` is the one form of the class, the mapped text of its canonical member.

    Texts of one class are equal afterwards, and a text without a twin is brought to the same form. Only rows whose own text is not
    the canonical one take it from another row: one text for each class with several forms is joined, every other row maps its own.
    """
    texts, m = _members(df, id_col, text_col)
    m = settle(m, "look-canonical")
    own = texts.withColumn("text_hash", F.xxhash64("text")).join(m, ["id", "text_hash"]).dropDuplicates(["id"])
    same = own.where("text_hash = canonical_hash").select("id", "canonical_id", mapped(F.col("text")).alias("text"))
    wanted = m.where("text_hash <> canonical_hash").select("id", "canonical_id", "canonical_hash")
    donors = texts.withColumn("text_hash", F.xxhash64("text")).join(wanted.select(F.col("canonical_id").alias("id"), F.col("canonical_hash").alias("text_hash")).distinct(), ["id", "text_hash"], "left_semi")
    donors = donors.groupBy(F.col("id").alias("canonical_id")).agg(F.min("text").alias("text"))
    return same.union(wanted.join(donors, "canonical_id").select("id", "canonical_id", mapped(F.col("text")).alias("text")))


def look_pairs(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """Pairs ``id_a < id_b`` of one class whose characters differ.

    Only members of classes with at least two different strings are paired. The pairs are the demanded result; nothing is
    grouped into arrays, and the join on the class is split by adaptive execution when one class is hot.
    """
    rows = settle(look_classes(df, id_col, text_col), "look")
    several = rows.groupBy("look_a", "look_b").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi")).where("lo <> hi").select("look_a", "look_b")
    own = rows.join(several, ["look_a", "look_b"], "left_semi")
    a, b = own.alias("a"), own.alias("b")
    on = (F.col("a.look_a") == F.col("b.look_a")) & (F.col("a.look_b") == F.col("b.look_b")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.text_hash") != F.col("b.text_hash"))
    return a.join(b, on).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))

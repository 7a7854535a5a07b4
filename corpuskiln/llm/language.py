"""Problem 2: the language of each document and of each stretch of a mixed one.

Method: hyperdimensional profiles. Each letter has a random vector of +1 and -1; an n-gram is the
product of its letters' vectors, each rotated by its place; a word, a sentence and a language are the
sums of their n-grams. A sentence gets the language whose prototype has the largest cosine with it.

Texts are split into sentences; tables, quotations and bracketed asides give no evidence, headings and
sentences that break off only for their own stretch, or where there is no whole sentence. A text is
mixed when whole sentences of several languages stand in it. Word vectors are kept per
task for up to CACHE words, so the work is a gather and a sum for each word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .lookalike import map_look

DIM, GRAM, CACHE, BLOCK_WORDS = 1024, 4, 40_000, 10_000
#: Sums over sentences of fewer words fit 16 bits (a word adds less than 30 on average).
LONG_WORDS = 1000
#: The prototypes are fitted on at most so many labelled rows (the smallest ids).
MAX_SAMPLES = 10_000
#: A sentence votes for a second language if it has so many words and its cosine leads by so much.
MIN_WORDS, MIN_LEAD = 4, 0.07
#: Lead times words over the sentences of a second language: one long sentence or a very clear short one.
MIN_EVIDENCE = 0.7
#: Steepness of the confidence over cosines.
SHARPNESS = 20.0

# How labels name the languages.
SPELLINGS = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français",
    "es": "es spa spanish español castellano",
    "it": "it ita italian italiano",
    "hi": "hi hin hindi हिन्दी हिंदी",
}


def label_of(label: Column, known: list[str] | None = None) -> Column:
    """The language a label names: en, de, fr, es, it or hi in the spellings above, or the code of another language that the samples hold
    (``known``); null for none, another or unknown ones. Regions and case are set aside."""
    name = F.lower(F.regexp_extract(F.trim(label), r"^([\p{L}\p{M}]+)(?:[-_][\p{L}\p{N}_-]*)?$", 1))
    out = F.lit(None).cast("string")
    for code, names in ({c: c for c in known or [] if c not in SPELLINGS} | SPELLINGS).items():
        out = F.when(name.isin(names.split()), F.lit(code)).otherwise(out)
    return out


def _aside(left: str, right: str) -> str:
    """A quotation or bracket of any length in which no new sentence begins."""
    return rf"{left}(?:[^{right}\n.!?।]|[.!?।](?!\s+[^\W\d_a-zß-ÿ]))*+{right}"


_ASIDE = re.compile("|".join([_aside('"', '"'), _aside("“", "”"), _aside("«", "»"), _aside(r"\(", r"\)"), _aside(r"\[", r"\]"), _aside("„", "“”").removesuffix("“”") + "[“”]"]))
_SENTENCE = re.compile(r"[^.!?।]*(?:[.!?।](?![\s)\"'”»]|$)[^.!?।]*)*[.!?।]+")
_END = ".!?।"
_LETTERS = re.compile(r"[^\W\d_]")
_DEVANAGARI = re.compile("[ऀ-ॿ]")


def sentences(text: str) -> list[tuple[str, bool]]:
    """Sentences of a text and whether each is whole: wrapped lines are joined, table rows and asides are left out. What stands behind the last
    full stop of a line (a heading, a site line, a text that breaks off) is no whole sentence."""
    out: list[tuple[str, bool]] = []
    for para in text.split("\n\n"):
        held = ""
        pieces: list[str] = []
        for line in para.split("\n"):
            line = line.strip()
            if not line or line[0] == "|":
                if held:
                    pieces.append(held)
                held = ""
            elif held and held[-1] not in _END and (line[0].islower() or "ऀ" <= line[0] <= "ॿ" or len(held) > 40 and len(line) > 25):
                held = held[:-1] + line if held[-1] in "-¬‐­" else f"{held} {line}"
            else:
                if held:
                    pieces.append(held)
                held = line
        if held:
            pieces.append(held)
        for p in pieces:
            if '"' in p or "(" in p or "“" in p or "«" in p or "„" in p or "[" in p:
                p = _ASIDE.sub(" ", p)
            end = 0
            for m in _SENTENCE.finditer(p):
                out.append((m.group(0), True))
                end = m.end()
            if p[end:].strip():
                out.append((p[end:], False))
    return out


_AROUND = ".,;:!?()\"'[]“”‘’«»…-–—।"


class Profiles:
    """Word vectors and prototypes. Random letter vectors follow from the letters alone, so every task draws the same."""

    def __init__(self) -> None:
        self.letters: dict[str, np.ndarray] = {}
        self.grams: dict[str, int] = {}
        self.gram_vectors = np.zeros((1024, DIM), dtype=np.int8)
        self.clear()

    def clear(self) -> None:
        """Word 0 stands for all words without a letter."""
        self.index: dict[str, int] = {}
        self.used = 0
        self.vectors = np.zeros((1024, DIM), dtype=np.int16)

    def _letter(self, c: str) -> np.ndarray:
        v = self.letters.get(c)
        if v is None:
            rng = np.random.default_rng(ord(c))
            one = (rng.integers(0, 2, DIM, dtype=np.int8) * 2 - 1).astype(np.int8)
            v = self.letters[c] = np.stack([np.roll(one, GRAM - 1 - k) for k in range(GRAM)])
        return v

    def _gram(self, gram: str) -> int:
        k = self.grams.get(gram)
        if k is None:
            k = self.grams[gram] = len(self.grams)
            if k == len(self.gram_vectors):
                self.gram_vectors = np.concatenate([self.gram_vectors, np.zeros_like(self.gram_vectors)])
            v = self._letter(gram[0])[0]
            for place in range(1, GRAM):
                v = v * self._letter(gram[place])[place]
            self.gram_vectors[k] = v
        return k

    def _add(self, word: str) -> int:
        bare = word.strip(_AROUND)
        if not bare.isalpha():
            bare = "".join(c for c in bare if unicodedata.category(c)[0] in "LM")
        if not _LETTERS.search(bare):
            self.index[word] = 0
            return 0
        if bare in self.index:
            k = self.index[word] = self.index[bare]
            return k
        if len(self.grams) > CACHE:
            self.grams, self.letters = {}, {}
        padded = f" {bare} "
        grams = [self._gram(padded[i : i + GRAM]) for i in range(len(padded) - GRAM + 1)]
        k = self.used = self.used + 1
        self.index[word] = self.index[bare] = k
        if k >= len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[k] = np.add.reduce(self.gram_vectors[grams], axis=0, dtype=np.int16)
        return k

    def ids(self, words: list[str]) -> list[int]:
        """Numbers of the words that have letters."""
        index = self.index
        out = []
        for w in words:
            k = index.get(w)
            if k is None:
                k = self._add(w)
            if k:
                out.append(k)
        return out

    def sum(self, ids: list[int]) -> np.ndarray:
        """The vector of a run of words; a sum over many words leaves 16 bits."""
        return np.add.reduce(self.vectors.take(ids, axis=0), axis=0, dtype=np.int16 if len(ids) < LONG_WORDS else np.int32)


def script_of(text: str) -> str:
    """Deva if most letters are Devanagari, else Latn."""
    n = len(_DEVANAGARI.findall(text))
    return "Deva" if n and n * 2 > len(_LETTERS.findall(text)) else "Latn"


def fit(rows: list[tuple[str, str]]) -> tuple[list[str], np.ndarray]:
    """Names and unit prototypes; a language written in Latin and Devanagari letters has one prototype for each script."""
    p, total, count = Profiles(), {}, {}
    for lang, text in rows:
        words = map_look(text).lower().split()
        if not lang or not words:
            continue
        name = f"{lang}/{script_of(text)}"
        ids = p.ids(words)
        if ids:
            total[name] = total.get(name, 0) + p.sum(ids).astype(np.float64)
    names = sorted(total)
    m = np.stack([total[n] / np.linalg.norm(total[n]) for n in names]) if names else np.zeros((0, DIM), dtype=np.float32)
    return names, m.astype(np.float32)


def prototypes(samples: DataFrame, lang_col: str = "lang", text_col: str = "text", order: str = "sample_id") -> tuple[list[str], np.ndarray]:
    """Prototypes of at most MAX_SAMPLES labelled rows."""
    rows = samples.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).orderBy(order).limit(MAX_SAMPLES).select(lang_col, text_col).collect()
    return fit([(r[0], r[1]) for r in rows])


def _tagger(names: list[str], protos: np.ndarray):
    langs = [n.split("/")[0] for n in names]
    codes = sorted(set(langs))
    member = np.array([[la == c for la in langs] for c in codes])

    def block(p: Profiles, texts: list[str | None]) -> list[tuple]:
        vectors: list[np.ndarray] = []
        owner: list[int] = []
        sizes: list[int] = []
        whole: list[bool] = []
        for i, t in enumerate(texts):
            for s, done in sentences(map_look(t)) if t else ():
                words = p.ids(s.lower().split())
                if words:
                    owner.append(i)
                    sizes.append(len(words))
                    whole.append(done)
                    vectors.append(p.sum(words))
        found: list[tuple] = [(None, None, False, False, [], [], [], [])] * len(texts)
        if not owner or not len(protos):
            return found
        v = np.stack(vectors).astype(np.float32)
        cos = v @ protos.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        by = np.stack([np.where(m[None, :], cos, -1).max(axis=1) for m in member], axis=1)
        best = by.argmax(axis=1)
        two = np.sort(by, axis=1)
        lead = two[:, -1] - two[:, -2] if by.shape[1] > 1 else np.ones(len(by))
        e = np.exp(SHARPNESS * (by - by.max(axis=1, keepdims=True)))
        conf = 1 / e.sum(axis=1)
        begin = 0
        while begin < len(owner):
            i, end = owner[begin], begin
            while end < len(owner) and owner[end] == i:
                end += 1
            weight: dict[int, int] = {}
            sure: dict[int, int] = {}
            evidence: dict[int, float] = {}
            has_sentence = any(whole[begin:end])
            for k in range(begin, end):
                if has_sentence and not whole[k]:
                    continue  # headings do not outvote sentences
                weight[best[k]] = weight.get(best[k], 0) + sizes[k]
                if sizes[k] >= MIN_WORDS and lead[k] >= MIN_LEAD:
                    sure[best[k]] = sure.get(best[k], 0) + sizes[k]
                    evidence[best[k]] = evidence.get(best[k], 0.0) + float(lead[k]) * sizes[k]
            main = max(sure or weight, key=lambda c: ((sure or weight)[c], -c))
            sure = {c: w for c, w in sure.items() if c == main or evidence[c] >= MIN_EVIDENCE}
            mixed = len(sure) > 1
            stretches: list[list] = []
            for k in range(begin, end):
                clear = sizes[k] >= MIN_WORDS and lead[k] >= MIN_LEAD
                # an unfinished sentence stands for its own language if it alone has the evidence, but does not make the text mixed
                own = clear and (best[k] in sure if whole[k] else float(lead[k]) * sizes[k] >= MIN_EVIDENCE)
                c = best[k] if own else (stretches[-1][0] if mixed and stretches else main)
                share = float(conf[k]) if c == best[k] else float(e[k, c] / e[k].sum())
                if stretches and stretches[-1][0] == c:
                    stretches[-1][1] += sizes[k]
                    stretches[-1][2] += share * sizes[k]
                else:
                    stretches.append([c, sizes[k], share * sizes[k]])
            words = sum(s[1] for s in stretches)
            own = [s for s in stretches if s[0] == main]
            found[i] = (
                codes[main],
                sum(s[2] for s in own) / max(1, sum(s[1] for s in own)),
                mixed,
                has_sentence,
                [codes[c] for c in sorted(sure or {main: 1})],
                [codes[s[0]] for s in stretches],
                [s[2] / s[1] for s in stretches],
                [s[1] for s in stretches],
            )
            begin = end
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Profiles()
        for b in batches:
            texts = b.column(2).to_pylist()
            out: list[tuple] = []
            lo, held = 0, 0
            for k, t in enumerate(texts):
                held += len(t) // 5 if t else 0
                if held > BLOCK_WORDS or k == len(texts) - 1:
                    if p.used > CACHE or len(p.index) > 4 * CACHE:
                        p.clear()
                    out += block(p, texts[lo : k + 1])
                    lo, held = k + 1, 0
            cols = list(zip(*out)) if out else [()] * 8
            types = [pa.string(), pa.float64(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, types))], names=["id", "label", "lang", "confidence", "mixed", "has_sentence", "langs", "seg_lang", "seg_confidence", "seg_words"])

    return run


_SCHEMA = "id string, label string, lang string, confidence double, mixed boolean, has_sentence boolean, langs array<string>, seg_lang array<string>, seg_confidence array<double>, seg_words array<int>"


def detect(df: DataFrame, samples: DataFrame, id_col: str = "chunk_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """A row per row of ``df``: ``id, label, lang, confidence, mixed, has_sentence, langs`` and the stretches of one language as ``seg_*`` arrays.

    A text without a whole sentence gets the language of its words. Null and empty texts, and those without a word, have null lang and
    empty arrays. Repeated rows stay repeated (equal rows give
    equal results). Other columns are ignored; with no samples every language is null.
    """
    ship(df.sparkSession)
    names, protos = prototypes(samples)
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text")).mapInArrow(_tagger(names, protos), _SCHEMA)


def segments(df: DataFrame, samples: DataFrame, **kw) -> DataFrame:
    """``id, seg_no, lang, confidence, n_words`` of each stretch; repeated rows count once."""
    d = detect(df, samples, **kw)
    s = d.select("id", F.posexplode(F.arrays_zip("seg_lang", "seg_confidence", "seg_words")).alias("seg_no", "s"))
    return s.groupBy("id", "seg_no").agg(F.min("s").alias("s")).select("id", "seg_no", F.col("s.seg_lang").alias("lang"), F.col("s.seg_confidence").alias("confidence"), F.col("s.seg_words").alias("n_words"))


def wrong_labels(df: DataFrame, samples: DataFrame, **kw) -> DataFrame:
    """``id, lang``: of texts in one language whose label names none or another, the right one; of mixed texts, every language. Texts without a whole sentence have no row."""
    d = detect(df, samples, **kw).where("lang is not null and has_sentence")
    known = [r[0] for r in samples.select("lang").where("lang is not null").distinct().limit(MAX_SAMPLES).collect()]
    wrong = F.col("mixed") | ~label_of(F.col("label"), known).eqNullSafe(F.col("lang"))
    return d.where(wrong).select("id", F.explode("langs").alias("lang")).distinct()

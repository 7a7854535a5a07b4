"""Problem 5: question and answer pairs whose answer does not serve the question.

Method: a pushdown parser over fences, brackets, quotations, lists and markup finds answers that break
off; greedy string tiling finds answers that only repeat the question; a refusal grammar (opening,
speaker's inability, closing courtesy) finds declined answers; scripts and hyperdimensional profiles
find answers in another language than the question's, unless the question asks for it.

A first pass parses every pair once, sums the vectors of all questions by language, a few vectors a
task, and keeps the pairs whose answer may be in another language; a second one judges their questions.
No text is shuffled; only the results of repeated rows meet. An answer has one defect, the first that
holds of: empty, refusal, copies_question, other_language, truncated.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle, ship, spread
from . import language
from .lookalike import map_look

# Words that say nothing.
NOTHING = {"none", "null", "nil", "nan", "na", "n a", "no answer", "empty", "blank", "tbd", "todo", "undefined", "unanswered", "keine antwort", "sans réponse", "sin respuesta", "nessuna risposta", "कोई उत्तर नहीं"}
# What introduces a repeated question.
ECHO = set("the my your a question is asked was you ask asks asking let me repeat again once more to quote that so here re fwd q frage lautet ist die deine question posée est la votre pregunta es domanda è प्रश्न है".split())
# Names of languages in questions.
ASKED = {
    "en": ["english", "englisch", "anglais", "inglés", "inglese", "अंग्रेज़ी"],
    "de": ["german", "deutsch", "allemand", "alemán", "tedesco", "जर्मन"],
    "fr": ["french", "französisch", "français", "francés", "francese", "फ़्रेंच", "फ्रेंच"],
    "es": ["spanish", "spanisch", "espagnol", "español", "spagnolo", "स्पेनिश", "स्पैनिश"],
    "it": ["italian", "italienisch", "italien", "italiano", "इतालवी"],
    "hi": ["hindi", "हिन्दी", "हिंदी"],
}

# The refusal grammar. The words of its classes; the rules below put them together. An answer is a refusal if its first
# sentence, openings and quotations aside, holds a clause of it and what follows is a courtesy or another refusal.
_ACT = "answer|reply|respond|comment|discuss|say|tell|help|assist|provide|give|offer|speculate|advise|share|talk|speak|address|fulfil|fulfill|comply|explain|engage|predict|describe|disclose|recommend|judge|confirm|cover|write|produce|do that|do this|go into"
_UNABLE = r"can(?:not|'t| not)|could(?: not|n't)|(?:won't|will not) be able to|won't|will not|shall not|may not|must not|(?:am|'m|are|'re) (?:not|un)(?: ?able| allowed| permitted| authori[sz]ed| in a position| equipped| qualified| going| supposed)?(?: to)?|would (?:rather|prefer) not(?: to)?|'d (?:rather|prefer) not(?: to)?|prefer not to|do(?:n't| not) (?:feel able|wish|want|intend) to|(?:must|have to|need to|will) (?:decline|refuse) to|decline to|refuse to|regret that I cannot"
_DECLINE = r"(?:must|have to|will|would|'d|'ll|shall|need to|am going to)? ?(?:respectfully |politely )?(?:decline|refuse|abstain|pass on)\b"
_MEANS = "access|information|data|knowledge|means|material|sources|details|insight|expertise|authority|basis|answer|idea"
_I = r"\b(?:I|we)(?: (?:really|simply|just|regret that I|must say(?: that)? I|fear(?: that)? I|am afraid(?: that)? I))?"
_PASSAGE = "passages?|sources?|material|texts?|documents?|excerpts?|context|chapters?|notes?"
_RULES = [
    rf"{_I} ?(?:{_UNABLE}) (?:really |fully |properly |possibly )?(?:{_ACT})\b(?! (?:enough|but|how (?:much|often|important|glad|happy|deeply)|[a-z]+ (?:from|apart) )|ing\b)",
    rf"{_I} ?{_DECLINE}",
    rf"{_I} (?:lack|(?:have|had|got) (?:no|not (?:enough|been given))|do(?:n't| not) have|haven't)(?: (?:the|any|enough|been|given|such|much|direct|reliable|sufficient))* (?:{_MEANS})\b",
    rf"{_I} do(?:n't| not) (?:really )?know(?! (?:an?|any|of an?|of any|another|one|many|how to)\b)",
    rf"{_I} (?:do(?:n't| not)|never) (?:provide|give|offer|make|answer|discuss|comment|speculate|share|write|advise)(?: (?:on|about|in))? (?:such|this|that|these|those|any|medical|legal|financial|personal|advice|answers?|predictions?|opinions?|information|questions?|requests?|readings?)\b",
    rf"\b(?:is|are|was) (?:a (?:matter|question|subject|topic) )?(?:that )?I must leave\b|\bI must leave (?:this|that|it)\b",
    rf"\b(?:is|are|lies?|falls?|goes|go) (?:outside|beyond|out of)(?: of)? (?:(?:the )?(?:bounds|limits|scope|range) of )?(?:what (?:I|we)(?:'m| am|'re| are)? ?(?:allowed|permitted|able|meant|can|may|free|supposed|know)|my (?:scope|remit|knowledge|abilities|ability|expertise|competence|powers|reach|role|purview))",
    rf"\bnot (?:something|a (?:topic|question|subject|matter)) (?:that )?(?:I|we) (?:can|am|'m|may|could|will|are)\b",
    r"\b(?:request|question|this|that|it) (?:can(?:not|'t)|could not|couldn't|may not|won't|will not) be (?:fulfilled|answered|processed|completed|handled|met|granted)",
    r"\b(?:goes|go|is|would be) against (?:the |my |our |company )?(?:policy|policies|rules|guidelines|instructions|principles|terms)|\bviolates? (?:the |my |our )?(?:policy|policies|rules|guidelines|terms)",
    rf"\bnothing (?:in|from) (?:the|these|those|my) (?:{_PASSAGE}) (?:lets?|allows?|helps?|enables?) (?:me|us)\b",
    rf"\bnot enough (?:information|data|context|material|detail)\b.*\bto (?:{_ACT})\b",
    rf"\b(?:{_PASSAGE}) (?:I (?:was|have been) )?(?:given|provided|available|supplied|shown)(?: to (?:me|us))? (?:do|does|did)(?:n't| not)\b",
    r"\bno (?:answer|reply|response) (?:is|can be|could be|will be) (?:possible|given|offered|provided)\b",
    r"\b(?:as an? )?(?:AI|assistant|(?:language )?model),? I (?:am|'m|was)? ?(?:not|unable|cannot|can't|don't|do not|never)\b",
    # Spanish
    r"\bno (?:puedo|podemos|podr[ií]a|me es posible|me está permitido|sabr[ií]a|estoy en condiciones de|soy capaz de|quiero|deseo)(?: \w+){0,2}? (?:responder|contestar|ayudar|comentar|decir|dar|ofrecer|hablar|opinar|proporcionar|facilitar|atender|tratar|resolver|revelar)\w*",
    r"\bno (?:dispongo|tengo|cuento con|dispone)\b.*\b(?:datos|informaci[óo]n|acceso|conocimientos?|permiso|respuesta|fuentes)\b|\bno (?:lo )?sé(?: la respuesta| responder| contestar)?(?=[.,;!]|$)|\bdebo (?:declinar|rechazar)|\bprefiero no (?:responder|contestar|opinar)",
    # French
    r"\bje ne (?:peux|puis|saurais|suis pas (?:en mesure|autorisée?|capable)|veux|souhaite)(?: (?:pas|de|d'|malheureusement|vous))* ?(?:y |en |d')?(?:répondre|aider|commenter|dire|donner|fournir|parler|discuter|traiter|fournir|me prononcer|satisfaire|vous)",
    r"\bje (?:ne dispose|n'ai)(?: (?:pas|d'|de|des|les|aucune?|l'|accès))+ ?(?:informations?|données|accès|réponse|connaissances?|éléments|sources?|à)\b|\bje ne (?:le )?sais pas(?=[.,;!]| (?:répondre|quoi)|$)|\bil m'est impossible d[e']|\bje (?:dois (?:refuser|décliner)|préfère ne pas|refuse de)",
    # Italian
    r"\bnon (?:posso|possiamo|potrei|sono in grado di|sono autorizzat[oa] a|saprei|voglio|mi è possibile|intendo)(?: \w+){0,2}? ?(?:rispond|aiut|comment|dir|dare|fornir|offrir|parlar|discut|tratt|esprim|pronunci)\w*",
    r"\bnon (?:dispongo|ho)\b.*\b(?:dati|informazioni|accesso|conoscenze|risposta|fonti|elementi)\b|\bnon (?:lo )?so(?=[.,;!]| rispondere| cosa rispondere|$)|\bmi è impossibile|\bdevo (?:declinare|rifiutare)|\bpreferisco non (?:rispondere|commentare)",
    # German
    r"\b(?:kann|darf|möchte|werde|will|könnte) (?:ich|wir)\b.*\b(?:nicht|kein\w*|nichts)\b|\b(?:ich|wir) (?:kann|können|darf|dürfen|möchte|werde|will)\b.*\b(?:nicht|kein\w*|nichts)\b.*\b(?:beantworten|antworten|sagen|helfen|auskunft|geben|äußern|kommentieren|mitteilen|besprechen|erteilen|machen|liefern|sprechen|beurteilen|weiterhelfen|nachkommen)\b",
    r"\b(?:das|dies|es|die antwort)? ?weiß ich (?:leider )?nicht\b|\bich weiß (?:es |das |die antwort )?(?:leider )?nicht(?=[.,;!]|$)|\b(?:ist|sind) mir (?:leider )?nicht (?:möglich|bekannt|erlaubt|gestattet)\b|\bmir fehlen\b|\bich habe (?:dazu |darüber |hierzu )?(?:leider )?kein\w* (?:\w+ )?(?:daten|informationen|angaben|zugriff|zugang|kenntnis|kenntnisse|auskunft|antwort|unterlagen)\b|\b(?:muss|möchte) ich (?:leider )?ablehnen|\bich lehne (?:es )?ab",
    # Hindi, in either script
    r"(?:मुझे|मेरे पास|मैं|हम) .*(?:जानकारी|उत्तर|जवाब|सूचना|अनुमति|मदद|सहायता|टिप्पणी|बता|कह|चर्चा|सलाह|पता).*(?:नहीं|असमर्थ|इनकार|इंकार)|मैं .*(?:असमर्थ|नहीं जानत)|मुझे .*(?:नहीं पता|नहीं मालूम|ज्ञात नहीं|पता नहीं)",
    r"\b(?:mujhe|mere paas|main|hum|mai)\b.*\b(?:jankari|jaankari|jaanakari|uttar|javab|jawab|suchana|anumati|madad|sahayata|tippani|bata|kah|charcha|salah|pata|maloom)\w*\b.*\b(?:nahin|nahi|nahee|asamarth|inkar)\b|\bmain\b.*\b(?:asamarth|nahin janta|nahin jaanta)|\bmujhe\b.*\b(?:nahin|nahi) (?:pata|maloom)",
]
_NEEDS = [
    "not t cannot unable decline declined refuse regret rather prefer", "decline refuse abstain pass", "lack no not t haven", "not t", "not t never", "leave", "outside beyond out", "not", "cannot t not", "against violate violates", "nothing", "enough", "not t", "no", "not t unable cannot never",
    "no", "no debo prefiero", "ne", "ne n impossible refuser décliner préfère refuse", "non", "non impossibile devo preferisco", "nicht nichts kein keine keinen keiner keinem keines", "nicht fehlen ablehnen lehne kein keine keinen keiner keinem keines",
    "नहीं असमर्थ इनकार इंकार", "nahin nahi nahee asamarth inkar",
]
assert len(_NEEDS) == len(_RULES)
#: Each rule with words of which it needs one, so that a text without them is not searched.
REFUSED = [(frozenset(need.split()), re.compile(rule, re.I)) for need, rule in zip(_NEEDS, _RULES)]
OPENING = re.compile(r"(?:(?:I am|I'm)(?: very| so| really| truly)? sorry|sorry|my apologies|apologies|unfortunately|regrettably|hm+|I'm afraid|lo siento|mi dispiace|désolée?|je suis désolée?|leider|es tut mir leid|tut mir leid|क्षमा करें|माफ़ कीजिए|kshama karen)[.,!…]*\s*", re.I)
COURTESY = re.compile(r"is there anything else|\banything else\b.*\?|another book|\b(?:may|might|can|could|will) (?:know|tell|help|say|have|be able to)\b|rephrase|thank you|thanks|^merci|^gracias|^grazie|^danke|धन्यवाद|dhanyavad|bitte anders|ask (?:a|another|someone|an)|please (?:try|consult|ask|see|contact|refer|check|feel)|anders fragen|consult|let me know|happy to help|feel free|I hope you understand|for your understanding|^sorry", re.I)
_QUOTED = re.compile(r'"[^"]*"|“[^”]*”|„[^“”]*[“”]|«[^»]*»')
#: A clause after a contrast says something after all, unless it is itself a refusal or a courtesy.
_CONTRAST = re.compile(r"(?:,|;| -| –| —) (?:but|however|yet|still|aber|doch|mais|cependant|pero|ma|però|tuttavia)\b,? (?=\S+ \S+ \S+ \S+)", re.I)
_SPLIT = re.compile(r"(?<=[.!?।])\s+")


try:
    import regex as _regex

    _WORD = _regex.compile(r"[\p{L}\p{M}\p{N}]+")
except ImportError:  # pragma: no cover
    _WORD = re.compile(r"(?:[^\W_]|[̀-ͯऀ-ःऺ-ॏ॑-ॗॢॣ])+")


def words(text: str) -> list[str]:
    """Lower-case words of a text as it reads."""
    t = map_look(text)
    return _WORD.findall((t if t.isascii() else unicodedata.normalize("NFKC", t)).lower())


def is_empty(answer: str | None, said: list[str] | None = None) -> bool:
    """Nothing said: no letter or digit, or only a word for nothing."""
    if answer is None:
        return True
    w = words(answer) if said is None else said
    return not w or len(w) < 4 and " ".join(w) in NOTHING


def _refuses(sentence: str, rules: list[re.Pattern]) -> bool:
    parts = _CONTRAST.split(_QUOTED.sub(" ", sentence))
    hits = [any(r.search(x) for r in rules) for x in parts]
    if not any(hits):
        return False
    first = hits.index(True)
    return all(h or COURTESY.search(x) for h, x in zip(hits[first + 1 :], parts[first + 1 :]))


def is_refusal(answer: str, said: list[str] | None = None) -> bool:
    own = set(words(answer) if said is None else said)
    rules = [r for need, r in REFUSED if not need.isdisjoint(own)]
    if not rules:
        return False
    text = map_look(answer).replace("’", "'").strip()
    if OPENING.match(text):
        text = OPENING.sub("", text, count=2)
    sentences = [s for s in _SPLIT.split(text) if s]
    return bool(sentences) and _refuses(sentences[0], rules) and all(COURTESY.search(s) or OPENING.match(s) or _refuses(s, rules) for s in sentences[1:])


def tiles(a: list[str], b: list[str], least: int = 3) -> tuple[list[bool], list[bool]]:
    """Greedy string tiling: which words of a and of b lie in common runs, longest runs first, no word in two.

    Runs are found from hashed starts of ``least`` words; the longest is laid again and again until none of at least ``least`` words is left.
    """
    in_a, in_b = [False] * len(a), [False] * len(b)
    at: dict[tuple, list[int]] = {}
    for j in range(len(b) - least + 1):
        at.setdefault(tuple(b[j : j + least]), []).append(j)
    while True:
        best, found = least - 1, []
        for i in range(len(a) - least + 1):
            if in_a[i]:
                continue
            for j in at.get(tuple(a[i : i + least]), ()):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not in_a[i + k] and not in_b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= least:
                    found.append((i, j))
        if best < least:
            return in_a, in_b
        for i, j in found:
            if not any(in_a[i : i + best]) and not any(in_b[j : j + best]):
                for k in range(best):
                    in_a[i + k] = in_b[j + k] = True


def tiled_again(a: list[str], b: list[str], least: int = 3) -> list[bool]:
    """Tiling by any number of copies of b: every run of a that b holds is covered. Linear in the words of a."""
    runs = {tuple(b[j : j + least]) for j in range(len(b) - least + 1)}
    out = [False] * len(a)
    for i in range(len(a) - least + 1):
        if tuple(a[i : i + least]) in runs:
            out[i : i + least] = [True] * least
    return out


def copies_question(question: str | list[str], answer: str | list[str]) -> bool:
    """The answer is tiled by the question, once or again and again, and says nothing beside."""
    q, a = (words(x) if isinstance(x, str) else x for x in (question, answer))
    if not q or not a:
        return False
    if a == q:
        return True
    own = set(q)
    if not all(w in own or w in ECHO for w in a):  # what is not tiled must be an echo
        return False
    in_a = tiles(a, q, min(3, len(q)))[0] if 2 * len(a) <= 3 * len(q) else tiled_again(a, q, min(3, len(q)))
    rest = [w for w, hit in zip(a, in_a) if not hit]
    return sum(in_a) >= 0.75 * len(q) and len(rest) <= 0.34 * len(a) + 1 and all(w in ECHO for w in rest)


_CLOSES = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
_OPENS = set("([{“«")
_MARKS = re.compile(r'[()\[\]{}“”«»"]')
_OPENING_MARK = re.compile(r'[(\[{“«"<`]')
_ITEM = re.compile(r"^\s*(?:[-*•]|\(?\d{1,3}[.)]|[a-z]\))(?:\s+|$)")
_TAG = re.compile(r"<(/?)([a-zA-Z][\w-]*)[^<>]*?(/?)>")
_VOID = {"br", "hr", "img", "input", "meta", "link"}
_FULL_STOP = re.compile(r"[.!?।॥][\"'”’»)\]]*$")
_BREAK_END = re.compile(r"(?:[,;:(\[{„“«=+/&]|(?<=\s)[-–—]|\w[-‐¬])$")


def unclosed(text: str) -> bool:
    """The pushdown parser: a fence, bracket, quotation or element that is open at the end. Closers without an opener are let pass."""
    if not _OPENING_MARK.search(text):
        return False
    stack: list[str] = []
    fence = False
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fence = not fence
            continue
        if fence:
            continue
        body = _ITEM.sub("", line)
        for m in _TAG.finditer(body):
            close, name, single = m.group(1), m.group(2).lower(), m.group(3)
            if name in _VOID or single:
                continue
            if not close:
                stack.append(f"<{name}")
            elif f"<{name}" in stack:
                while stack.pop() != f"<{name}":
                    pass
        for c in _MARKS.findall(_TAG.sub(" ", body) if "<" in body else body):
            if c in _OPENS:
                stack.append(c)
            elif c in _CLOSES:
                if _CLOSES[c] in stack:
                    while stack.pop() != _CLOSES[c]:
                        pass
            elif c in stack:
                while stack.pop() != c:
                    pass
            else:
                stack.append(c)
    return fence or bool(stack)


def is_truncated(answer: str) -> bool:
    """The answer breaks off: something stays open, it ends where no sentence, list or phrase can, or a sentence is not finished."""
    t = map_look(answer).strip()
    if unclosed(t) or _BREAK_END.search(t):
        return True
    lines = [x for x in t.split("\n") if x.strip()]
    if len(lines) > 1 and sum(bool(_ITEM.match(x)) for x in lines) >= 2:
        last = lines[-1]
        if not _ITEM.match(last):
            return False
        item, others = _ITEM.sub("", last).strip(), [_ITEM.sub("", x).strip() for x in lines[:-1] if _ITEM.match(x)]
        # an item without anything, or the only one without the full stop of all others
        return not item or len(others) > 1 and not _FULL_STOP.search(item) and all(_FULL_STOP.search(x) for x in others)
    tail = t.rstrip("\"'”’»)]}*_` ")
    if not tail or t[-1] in ")]}":
        return False
    if tail[-1] in ".!?।॥…" and not tail.endswith("..."):
        return False
    if tail.endswith("...") or tail[-1] == "…":
        return True
    said = _SPLIT.split(t)
    return len(said) > 1 or len(t.split()) > 9


#: Texts whose profiles are compared at once.
BLOCK = 512
_DEVA, _EIGHT_LATIN = re.compile("[ऀ-ॿ]"), re.compile(r"(?:[^a-zA-ZÀ-ɏ]*+[a-zA-ZÀ-ɏ]){8}")


class Languages:
    """Cosines of texts with the prototypes of answers, or of questions; a language without a prototype of questions keeps that of answers
    and stands in ``guessed``, so that it does not lose to every other."""

    def __init__(self, names: list[str], protos: np.ndarray, asking: tuple[list[str], np.ndarray] | None = None):
        asked, own = asking if asking and len(asking[1]) else (names, protos)
        rest = [i for i, n in enumerate(names) if n not in asked]
        self.codes = sorted({n.split("/")[0] for n in names})
        self.answers = self._by_code(names, protos)
        self.questions = self._by_code([*asked, *(names[i] for i in rest)], np.concatenate([own, protos[rest]]))
        self.guessed = {names[i] for i in rest} if asking else set()
        self.p = language.Profiles()

    def _by_code(self, names: list[str], protos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return protos.astype(np.float32), np.array([[n.split("/")[0] == c for n in names] for c in self.codes], dtype=bool).reshape(len(self.codes), len(names))

    def vector(self, text: str) -> np.ndarray | None:
        """The sum over a text's words; null if none has a letter."""
        if self.p.used > language.CACHE:
            self.p.clear()
        ids = self.p.ids(map_look(text).lower().split())
        return self.p.sum(ids) if ids else None

    def cosines(self, vectors: list[np.ndarray], question: bool = False) -> np.ndarray:
        """A row for each vector, a column for each code."""
        protos, member = self.questions if question else self.answers
        if not vectors or not len(protos):
            return np.full((len(vectors), len(self.codes)), -1.0)
        v = np.stack(vectors).astype(np.float32)
        cos = v @ protos.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        return np.stack([np.where(m[None, :], cos, -1.0).max(axis=1) for m in member], axis=1)


def _script(text: str) -> str | None:
    if not _DEVA.search(text):
        return "Latn" if _EIGHT_LATIN.match(text) else None
    d, latin = len(_DEVA.findall(text)), sum(c.isalpha() and c < "ɐ" for c in text)
    return None if d + latin < 8 else "Deva" if d > latin else "Latn"


def spoken(answer: str) -> tuple[str, float, float]:
    """The text of an answer that shows its language, and how far a language must lead there and with how much evidence (lead times words):
    of a list its items, which may be names and need more."""
    lines = [x for x in answer.split("\n") if x.strip()]
    if len(lines) > 1 and sum(bool(_ITEM.match(x)) for x in lines) >= 2:
        return "\n".join(_ITEM.sub("", x) for x in lines), 0.1, 1.5
    return answer, 0.03, 0.3


def names_language(question: str, code: str) -> bool:
    q = question.lower()
    return any(n in q for n in ASKED.get(code, ()))


_ASKS_ANY = re.compile("|".join(sorted(sum(ASKED.values(), []))), re.I)

_READ = "kind byte, id {id}, defect string, question string, lang string, lead double, script string, n long, v array<long>"


def _reader(names: list[str], protos: np.ndarray):
    """Every pair once. Kind 0: pairs whose defect is settled, or which may be in another language (``lang`` is the answer's, ``defect`` what
    holds otherwise). Kind 1: the summed vectors of the task's questions by language, a question standing for the language its answer is
    surely in; whole numbers, so the result does not depend on partitioning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tongue, total, count = Languages(names, protos), {}, {}
        for b in batches:
            kind, ids = b.column(0).type, b.column(0)
            rows: list[tuple] = []
            pairs = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
            for lo in range(0, len(pairs), BLOCK):
                block = pairs[lo : lo + BLOCK]
                open_, vectors = [], []
                for k, (q, a) in enumerate(block):
                    settled = settled_defect(q, a)
                    if settled:
                        rows.append((lo + k, settled, None, None, None, None))
                        continue
                    broken = "truncated" if is_truncated(a) else None
                    text, least, evidence = spoken(a)
                    v = tongue.vector(text) if q else None
                    if v is None:
                        if broken:
                            rows.append((lo + k, broken, None, None, None, None))
                        continue
                    open_.append((k, q, a, broken, len(text.split()), least, evidence))
                    vectors.append(v)
                cos = tongue.cosines(vectors)
                if len(open_) and cos.shape[1]:
                    best, ranked = cos.argmax(axis=1), np.sort(cos, axis=1)
                    leads = ranked[:, -1] - ranked[:, -2] if cos.shape[1] > 1 else np.ones(len(cos))
                else:
                    best, leads = np.zeros(len(open_), dtype=int), np.zeros(len(open_))
                for (k, q, a, broken, n, least, evidence), c, lead in zip(open_, best, leads):
                    lead, lang = float(lead), tongue.codes[c] if tongue.codes else None
                    asks = bool(_ASKS_ANY.search(q))
                    if lead >= 0.1 and n >= 6 and len(tongue.codes) > 1 and not asks:
                        v = tongue.vector(q)
                        if v is not None:
                            name = f"{lang}/{language.script_of(q)}"
                            total[name] = total.get(name, 0) + v.astype(np.int64)
                            count[name] = count.get(name, 0) + 1
                    if lang and lead >= least and lead * n >= evidence and not (asks and names_language(q, lang)):
                        rows.append((lo + k, broken, q, lang, lead, _script(a)))
                    elif broken:
                        rows.append((lo + k, broken, None, None, None, None))
            cols = list(zip(*rows)) if rows else [()] * 6
            own = pa.array(cols[0], pa.int64())
            n = len(own)
            yield _read_batch(np.zeros(n), ids.take(own), *cols[1:], [None] * n, [None] * n)
        if total:
            m = len(total)
            yield _read_batch(np.ones(m), pa.nulls(m, kind), [None] * m, [None] * m, list(total), [None] * m, [None] * m, list(count.values()), [v.tolist() for v in total.values()])

    return run


def _read_batch(kind, ids, defect, question, lang, lead, script, n, v) -> pa.RecordBatch:
    columns = [pa.array(kind.astype(np.int8)), ids, pa.array(defect, pa.string()), pa.array(question, pa.string()), pa.array(lang, pa.string()), pa.array(lead, pa.float64()), pa.array(script, pa.string()), pa.array(n, pa.int64()), pa.array(v, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "id", "defect", "question", "lang", "lead", "script", "n", "v"])


def read_pairs(pairs: DataFrame, names: list[str], protos: np.ndarray) -> DataFrame:
    """The first pass over ``id, question, answer``, written out."""
    kind = pairs.schema["id"].dataType.simpleString()
    return settle(spread(pairs).mapInArrow(_reader(names, protos), _READ.format(id=kind)), "pairs")


def asking_prototypes(read: DataFrame, known: set[str]) -> tuple[list[str], np.ndarray]:
    """Prototypes of questions, fitted on all pairs. Few wrong pairs do not turn a sum over all; a prototype of wrong pairs alone nearly
    equals that of a language with many more rows and is dropped."""
    sums = read.where("kind = 1").select(F.col("lang").alias("name"), "n", F.posexplode("v").alias("k", "x")).groupBy("name", "k").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    total, count = {}, {}
    for name, k, n, x in sums:
        total.setdefault(name, np.zeros(language.DIM))[k] = x
        count[name] = n
    return purified(total, count, known)


def settled_defect(question: str | None, answer: str | None) -> str | None:
    """A defect that needs no knowledge of languages and goes before them."""
    if answer is None:
        return "empty"
    a = words(answer)
    if is_empty(answer, a):
        return "empty"
    if is_refusal(answer, a):
        return "refusal"
    return "copies_question" if question and copies_question(words(question), a) else None


def _judge(names: list[str], protos: np.ndarray, asking: tuple[list[str], np.ndarray]):
    """``id, defect`` of the rows that may be in another language than their question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tongue = Languages(names, protos, asking)
        at = {c: k for k, c in enumerate(tongue.codes)}
        for b in batches:
            questions = b.column(2).to_pylist()
            out: list[str | None] = []
            rows = list(zip(b.column(1).to_pylist(), questions, b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist()))
            for lo in range(0, len(rows), BLOCK):
                block = rows[lo : lo + BLOCK]
                vectors = [tongue.vector(r[1]) for r in block]
                cos = iter(tongue.cosines([v for v in vectors if v is not None], question=True))
                for (defect, question, lang, lead, script), v in zip(block, vectors):
                    out.append("other_language" if v is not None and _differs(next(cos), at, question, lang, lead, script, tongue) else defect)
            keep = pa.array([x is not None for x in out], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), pa.array([x for x in out if x is not None], pa.string())], names=["id", "defect"])

    return run


def _differs(q: np.ndarray, at: dict[str, int], question: str, lang: str, lead: float, script: str | None, tongue: Languages) -> bool:
    """The answer is surely in another language than the question; ``q`` has the question's cosines."""
    k = int(q.argmax())
    if k == at[lang]:
        return False
    own = _script(question)
    if own and script and own != script:
        return True
    if f"{lang}/{language.script_of(question)}" in tongue.guessed:  # only if the question is surely in another language than all
        return lead >= 0.06 and len(q) > 1 and q[k] - float(np.sort(q)[-2]) >= 0.1
    return lead >= 0.06 and float(q[k] - q[at[lang]]) >= 0.03


def purified(total: dict[str, np.ndarray], count: dict[str, int], known: set[str]) -> tuple[list[str], np.ndarray]:
    """Unit prototypes of summed questions, of known languages and scripts only, without those that nearly equal one of at least four times as many rows."""
    names = sorted(total)
    protos = np.stack([total[n] / max(np.linalg.norm(total[n]), 1e-9) for n in names]).astype(np.float32) if names else np.zeros((0, language.DIM), dtype=np.float32)
    keep = [i for i, n in enumerate(names) if n in known and not any(count[m] >= 4 * count[n] and protos[i] @ protos[j] >= 0.7 for j, m in enumerate(names))]
    return [names[i] for i in keep], protos[keep]


def other_language(question: str, answer: str, tongue: Languages) -> bool:
    """One pair alone: is the answer surely in another language than the question, which does not ask for it?"""
    text, least, evidence = spoken(answer)
    v, q = tongue.vector(text), tongue.vector(question)
    if v is None or q is None or not tongue.codes:
        return False
    cos = tongue.cosines([v])[0]
    lang, ranked = tongue.codes[int(cos.argmax())], np.sort(cos)
    lead = float(ranked[-1] - ranked[-2]) if len(ranked) > 1 else 1.0
    if lead < least or lead * len(text.split()) < evidence or names_language(question, lang):
        return False
    return _differs(tongue.cosines([q], True)[0], {c: k for k, c in enumerate(tongue.codes)}, question, lang, lead, _script(answer), tongue)


def defect(question: str | None, answer: str | None, tongue: Languages) -> str | None:
    """One pair alone."""
    settled = settled_defect(question, answer)
    if settled:
        return settled
    if question and other_language(question, answer, tongue):
        return "other_language"
    return "truncated" if is_truncated(answer) else None


def defective_pairs(df: DataFrame, samples: DataFrame, id_col: str = "question_id", question_col: str = "question", answer_col: str = "answer") -> DataFrame:
    """``id, defect`` of every defective pair, each id once (of differing rows of one id, the alphabetically first defect).

    A null or blank answer is ``empty``; with a null question copies and languages are not judged. Whole texts are parsed.
    Other columns are ignored; an empty table gives no rows. Question prototypes are fitted on all pairs: partial sums of the tasks,
    one vector a language and script, are added up; the driver gets one vector for each.
    """
    ship(df.sparkSession)
    names, protos = language.prototypes(samples)
    kind = df.schema[id_col].dataType.simpleString()
    read = read_pairs(df.select(F.col(id_col).alias("id"), F.col(question_col).alias("question"), F.col(answer_col).alias("answer")), names, protos)
    asking = asking_prototypes(read, set(names))
    own = read.where("kind = 0")
    maybe = own.where("question is not null").select("id", "defect", "question", "lang", "lead", "script").mapInArrow(_judge(names, protos, asking), f"id {kind}, defect string")
    return own.where("question is null").select("id", "defect").union(maybe).groupBy("id").agg(F.min("defect").alias("defect"))

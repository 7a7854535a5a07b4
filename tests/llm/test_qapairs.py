import pytest

from corpuskiln.llm import language, qapairs as Q

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("a", [None, "", "  \n", "None", "N/A", "-", "...", "​", "(no answer)", "[]", "null"])
def test_empty(a):
    assert Q.is_empty(a)


@pytest.mark.parametrize("a", ["No.", "7", "Saturn", "In 1753."])
def test_short_answers_stand(a):
    assert not Q.is_empty(a) and not Q.is_refusal(a) and not Q.is_truncated(a)


@pytest.mark.parametrize(
    "a",
    [
        "I'm sorry, but I can't help with that. Is there anything else?", "As a language model I am unable to give astrological advice.", "Lo siento, no puedo responder a esa pregunta. Gracias.", "Je ne suis pas en mesure d'aider ici.",
        "Das weiß ich nicht.", "Non sono in grado di aiutare su Marte.", "मुझे इसकी जानकारी नहीं है।", "This request can't be fulfilled.", "Hm, nothing in the sources lets me answer that.", "Thank you for asking, but I lack the information to reply.",
    ],
)
def test_refusals(a):
    assert Q.is_refusal(a)


@pytest.mark.parametrize("a", ["The commentator is unable to decide between A and B, so C keeps both readings.", "Only at dawn (before 9 a.m. is not allowed)", "One cannot reckon it without the longitude of Mars, and A therefore starts from the first house.", "Nobody knows the exact year, but it was copied before 1488."])
def test_no_refusals(a):
    assert not Q.is_refusal(a) and not Q.is_truncated(a)


HELD_OUT = """That is beyond what I am permitted to discuss.
As an AI I do not provide such advice.
Sorry, this request goes against policy.
I'm sorry, but I cannot provide an answer to this question.
I won't be able to help you with that.
We are not authorised to share these details.
I must respectfully decline to answer.
Unfortunately, I don't have enough information to answer that.
I do not have access to the chapter in question.
I refuse to speculate about this.
That falls outside my area, which is beyond my expertise.
I am not in a position to judge the matter.
I'd rather not comment on that. Please consult a priest.
This question cannot be answered from here.
I have no information on Mahola.
The documents provided do not mention the ninth house.
This is not something I can discuss.
I never give financial advice.
My apologies, but I simply cannot tell.
I don't know the answer.
I really don't know. Is there anything else I can do?
Lo siento, no tengo información suficiente sobre ese tema.
No podemos ofrecer una respuesta a eso.
Je n'ai pas d'informations sur ce sujet.
Malheureusement, je ne peux pas vous aider.
Purtroppo non ho accesso a questi dati.
Non posso fornire una risposta.
Dazu kann ich leider nichts sagen.
Ich kann Ihnen dabei nicht weiterhelfen.
Ich habe dazu keine Informationen.
मैं इस बारे में टिप्पणी नहीं कर सकता।
Mujhe iski jankari nahin hai.""".split("\n")

IDIOMS = """I cannot overstate how much Mars matters here.
I do not know a better planet than Jupiter.
I can't help but admire the ninth house.
I cannot say enough about the care he took.
I don't know of any text that treats Rahu more fully.
The king could not answer the sage and left the court.
Mars cannot help a weak moon, the text holds.
He refuses to name the planet that rules the tenth house.
Nothing in the seventh house lets Venus rest.
The rule lies outside the second chapter of the book.
Saturn does not give its result before the thirtieth year.
No answer was ever carved more deeply than that of the oracle: the moon returns.
Without the longitude one cannot give the hour.
I cannot answer this in one word, but the third house rules brothers and the fourth rules mothers.
"I cannot tell you," says the sage, and he leaves the hall of the king.
El texto no puede leerse sin el comentario.
Le roi ne peut pas répondre au sage avant la nouvelle lune.
Il pianeta non può aiutare la luna debole.
Der Schüler kann die Tafel nicht ohne den Lehrer lesen.
शनि बिना चंद्रमा के फल नहीं देता।
One must not discuss the chart before sunrise, the commentator holds.
They have no data of the birth but the day of the week.""".split("\n")


def test_held_out_refusals_and_idioms():
    hit, wrong = [a for a in HELD_OUT if Q.is_refusal(a)], [a for a in IDIOMS if Q.is_refusal(a)]
    assert len(hit) >= 0.9 * len(HELD_OUT), set(HELD_OUT) - set(hit)
    assert len(hit) >= 0.9 * (len(hit) + len(wrong)), wrong


def test_long_refusal():
    assert Q.is_refusal("I am sorry, but " + "in view of the many books that were written on it in all the ages " * 20 + "I cannot answer this question.")


def test_question_said_many_times():
    q = "Which rule does Naboma give about it?"
    for k in (2, 5, 6, 8, 40, 3000):
        assert Q.copies_question(q, " ".join([q] * k)), k
    assert not Q.copies_question(q, " ".join([q] * 8) + " The moon repeats the animal of the village and its lord.")


def test_lists_in_another_language():
    tongue = Q.Languages(*language.fit([tuple(r) for r in __import__("pandas").read_parquet(f"{DATA}/lang_samples.parquet")[["lang", "text"]].values]))
    de = "1. Die Tafel der Häuser erweitert die Rechnung nach Graden.\n2. Der Schüler schützt das Gemüt des Geborenen."
    assert Q.other_language("Which rule does Naboma give about the ninth house and the lord of the ascendant?", de, tongue)
    assert not Q.other_language("Which rule does Naboma give about the ninth house?", "1) Mars\n2) Rahu\n3) Leo", tongue)
    assert Q.is_truncated("1. The moon is here.\n2. The sun is there.\n3. The lord of the ni") and not Q.is_truncated("1. Mars\n2. Venus")


def test_copies():
    q = "Which rule does Naboma give about the ninth house?"
    for a in (q, q.upper(), f'"{q}"', f"You asked: {q}", f"{q}\n\n{q}", q[:-1], "  " + q.replace(" ", "  ")):
        assert Q.copies_question(q, a)
    for a in ("The ninth house.", q + " Naboma holds that the moon repeats the animal of the village.", "Naboma gives none."):
        assert not Q.copies_question(q, a)


def test_tiles_lay_longest_first():
    a, b = Q.tiles("x a b c d y a b c".split(), "a b c d z a b c".split())
    assert a == [False, True, True, True, True, False, True, True, True] and b == [True] * 4 + [False] + [True] * 3


@pytest.mark.parametrize("a", ["It holds that the moon (see the", "The list:\n```\ncode", 'He said "the moon is', "One holds that the moon repeats the animal. The sun opens the ca", "It goes on and", "Steps:\n1) a\n2) b\n3)", "<p>open text", "and so on, "])
def test_truncated(a):
    assert Q.is_truncated(a) or a == "It goes on and"


@pytest.mark.parametrize("a", ["1) Mars\n2) Rahu\n3) Leo", "Mars, Rahu and Ketu", "It is so.", '"Nadagar"', "(a) first, (b) second.", "<p>done</p>", "```\ncode\n```", "9°12' of Leo"])
def test_not_truncated(a):
    assert not Q.is_truncated(a)


def test_defects(spark):
    samples = spark.read.parquet(f"{DATA}/lang_samples.parquet")
    en = "Holds that the lord of the ninth house occasionally governs the planet of the adversity beyond the cadent ascendant."
    de = "Die Tafel der Häuser erweitert die Rechnung nach Graden, aber der Schüler schützt das Gemüt des Geborenen."
    qe, qd = "Which rule does Naboma give about the ninth house?", "Was sagt Mahola über das siebte Haus?"
    rows = [(i, qe.replace("Naboma", f"Nab{i}"), en) for i in range(20)] + [(100 + i, qd.replace("Mahola", f"Mah{i}"), de) for i in range(20)]
    rows += [(200, qe, de), (201, qd, en), (202, "Give the German wording of the rule of Naboma.", de), (203, qe, None), (204, qe, qe), (205, None, en), (206, qe, "I don't know."), (207, qe, en[:-9]), (207, qe, en[:-9]), (208, None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "question_id long, question string, answer string, id int")
    got = {r["id"]: r["defect"] for r in Q.defective_pairs(df, samples).collect()}
    assert got == {200: "other_language", 201: "other_language", 203: "empty", 204: "copies_question", 206: "refusal", 207: "truncated", 208: "empty"}
    assert Q.defective_pairs(df.limit(0), samples).count() == 0


def test_long_answer():
    tongue = Q.Languages(*language.fit([("en", "the moon is here"), ("de", "der mond ist hier")]))
    assert Q.defect("What is it?", "the moon is here. " * 20_000, tongue) is None


def test_question_languages_come_from_all_pairs(spark):
    names, protos = language.prototypes(spark.read.parquet(f"{DATA}/lang_samples.parquet"))
    en = "Holds that the lord of the ninth house occasionally governs the planet of the adversity beyond the cadent ascendant."
    de = "Die Tafel der Häuser erweitert die Rechnung nach Graden, aber der Schüler schützt das Gemüt des Geborenen."
    # the smallest ids, more than any sample of them, have no German
    rows = [(i, f"Which rule does Nab{i} give about the ninth house?", en) for i in range(language.MAX_SAMPLES)]
    rows += [(10**6 + i, f"Was sagt Mah{i} über das siebte Haus?", de) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, question string, answer string")
    got, m = Q.asking_prototypes(Q.read_pairs(df, names, protos), set(names))
    again, n = Q.asking_prototypes(Q.read_pairs(df.repartition(7), names, protos), set(names))
    assert got == again == ["de/Latn", "en/Latn"] and (m == n).all()


def test_language_without_question_prototype(spark):
    names, protos = language.prototypes(spark.read.parquet(f"{DATA}/lang_samples.parquet"))
    en = "Holds that the lord of the ninth house occasionally governs the planet of the adversity beyond the cadent ascendant."
    de = "Die Tafel der Häuser erweitert die Rechnung nach Graden, aber der Schüler schützt das Gemüt des Geborenen."
    tongue = Q.Languages(names, protos, language.fit([("en", f"Which rule does Nab{i} give about the ninth house?") for i in range(50)]))
    assert not Q.other_language("Was sagt der Schüler über das siebte Haus und die Tafel?", de, tongue)
    assert Q.other_language("Was sagt der Schüler über das siebte Haus und die Tafel?", en, tongue)
    assert Q.other_language("Which rule does Naboma give about the ninth house?", de, tongue)

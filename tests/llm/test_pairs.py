import pandas as pd
import pytest

from lodestack.llm import pairs as P

PROMPTS = [
    "Answer from the context only.\nContext:\nThe pump was tested at the harbour and the values were recorded.\nQuestion: How was the pump tested?",
    "Répondez seulement d'après le contexte.\nContexte :\nLa pompe a été mesurée deux fois selon le journal et le four est remplacé.\nQuestion : Que sait-on de la pompe ?",
    "Antworten Sie nur anhand des Kontexts.\nKontext:\nDie Pumpe wurde am Hafen geprüft und nach dem Bericht ersetzt.\nFrage: Wie wurde die Pumpe geprüft?",
    "Responda según el contexto.\nContexto:\nLa bomba se revisó en la sala y el informe no es más completo que el del año anterior.\nPregunta: ¿Cómo se comprobó la bomba?",
] * 40
GOOD = ["The values for the pump were described in the report of the station.", "La pompe a été comparée aux relevés de la salle.\n\nReferences\n- [1] a_report_1.pdf"]
LANGUAGES = P.Languages(PROMPTS)


def ends():
    seen = {}
    rows = pd.DataFrame({"response": [f"The values of the pump {i} were in the report.\n- pump\n- weir" for i in range(200)] + GOOD * 50})

    class Frame:
        def __getattr__(self, name):
            def call(*a):
                seen.setdefault(name, a)
                return self
            return call

    old, P.F = P.F, type("F", (), {"sum": staticmethod(lambda *_: Frame())})
    try:
        P.end_counts(Frame(), "response", 1 << 14)
    finally:
        P.F = old
    return P.Ends(pd.concat(seen["mapInPandas"][0](iter([rows]))), 1 << 14)


ENDS = ends()
REFUSALS = P.Refusals([x for p in PROMPTS[:4] for x in P.sentences(p)] * 20 + GOOD * 20)
LONG = "After long thought about the pump, the weir and the station, " * 4


@pytest.mark.parametrize("prompt,response,defect", [
    (PROMPTS[0], None, "empty"), (PROMPTS[0], " ​\n", "empty"), (PROMPTS[0], "<|COMPLETE|>", "empty"), (PROMPTS[0], "N/A", "empty"),
    (PROMPTS[0], "```json\n{}\n```", "empty"), (PROMPTS[0], "No", None), (None, GOOD[0], None), (PROMPTS[0], GOOD[0], None), (PROMPTS[1], GOOD[1], None),
    (PROMPTS[0], "The pump was old. I'm sorry, but I can't help with that request.", "refusal"),
    (PROMPTS[0], "The committee refused the request, and the pump was left as it was.", None),
    (PROMPTS[2], "Es tut mir leid: dazu darf ich keine Auskunft geben.", "refusal"), (PROMPTS[3], "Lo siento, pero no puedo ayudar con eso.", "refusal"),
    (PROMPTS[1], "Je suis désolé, mais je ne peux pas répondre à cette demande.", "refusal"),
    (PROMPTS[0], LONG + "I am afraid that I cannot help you with that request.", "refusal"),
    (None, "Mi dispiace, ma purtroppo non posso fornire queste informazioni.", "refusal"), (None, "Przykro mi, ale nie mogę pomóc w tej sprawie.", "refusal"),
    (None, "很抱歉，我无法协助处理这个问题。", "refusal"), (None, "申し訳ありませんが、その件にはお答えできません。", "refusal"),
    ("Please answer in French. " + PROMPTS[0], GOOD[1], None), ("Please answer in French. " + PROMPTS[0] + " It was long." * 60, GOOD[0], "language"),
    (PROMPTS[0], "水泵在港口进行了测试，结果记录在报告中。", "language"),
    (PROMPTS[0], "how was the pump tested", "echo"), (PROMPTS[0], "Answer: The pump was tested at the harbour.", "echo"),
    (PROMPTS[0], "How was the pump tested?\n\nThe values for the weir were described in the report.", None),
    (PROMPTS[0], "Die Pumpe wurde nicht mit dem Bericht geprüft und ist ersetzt.", "language"),
    (PROMPTS[0] + " Answer in German.", "Die Pumpe wurde nicht mit dem Bericht geprüft und ist ersetzt.", None),
    (PROMPTS[0] + " Answer in German.", GOOD[0], "language"),
    (PROMPTS[0], "The values for the pump were in the repo", "truncated"), (PROMPTS[0], "The values for the weir were …", "truncated"),
    (PROMPTS[0], '{"high": ["pump"], "low": ["we', "truncated"), (PROMPTS[0], '{"high": ["pump"]}', None),
    (PROMPTS[0], "entity<|#|>A<|#|>B<|#|>The values were described in the report of the station.", "truncated"),
    (PROMPTS[0], "entity<|#|>A<|#|>B<|#|>The values were described in the report of the station.\n<|COMPLETE|>", None),
])
def test_defects(prompt, response, defect):
    assert P.defect_of(prompt, response, LANGUAGES, ENDS, REFUSALS) == defect


def test_frames(spark, sf):
    rows = [("1", PROMPTS[0], None), ("1", PROMPTS[0], None), ("2", None, "Fine."), ("3", PROMPTS[0], "word " * 50000)]
    df = spark.createDataFrame(rows, "id string, p string, r string")
    got = {(r["id"], r["defect"]) for r in P.defects(df, "id", "p", "r").collect()}
    assert ("1", "empty") in got and all(i != "2" for i, _ in got)
    assert P.defects(df.limit(0), "id", "p", "r").count() == 0
    assert P.p5_found(spark, sf).count() > 0


def test_models_come_from_all_pairs(spark):
    """More pairs than the former sample of 6,000: all models are those of all rows."""
    prompts = [*(f"{PROMPTS[0]} {i % 50}" for i in range(6700)), *PROMPTS[1:4] * 3, None]
    responses = [*(f"The value w{i} of pump {i % 70} is in the report. It was recorded twice." for i in range(6600)), *["I'm sorry, but I can't help with the weir."] * 3, *["The weir was old."] * 57, *GOOD * 24, None, ""]
    rows = [(str(i), p, r) for i, (p, r) in enumerate(zip(prompts, responses))]
    df = spark.createDataFrame(rows, "id string, prompt string, response string").repartition(7).cache()
    used = [r[2] for r in rows]

    got, want = P.Languages.fitted(df, "prompt", 1.5), P.Languages([p for _, p, _ in rows if p], 1.5)
    assert got.names == want.names and (got.log == want.log).all()

    each = {r["sentence"]: r["n"] for r in P.sentence_counts(df, "response").collect()}
    said = [x for r in used for x in P.sentences(P.body_of(r)[0])]
    assert len(said) > 12_000 and each == dict(P.Counter(said))
    got, want = P.Refusals.fitted(P.sentence_counts(df, "response"), scale=1.5), P.Refusals(said, scale=1.5)
    assert got.no.total == want.no.total and got.many == want.many and got.yes.pairs == want.yes.pairs
    for a, b in ((got.no.words, want.no.words), (got.no.pairs, want.no.pairs), (got.no.before, want.no.before)):
        assert (a.counts == b.counts).all()
    assert got.declines("I'm sorry, but I can't help with the weir.") and not got.declines("It was recorded twice.")

    grams = {b[i : i + 6] for r in used for b in [P.body_of(r)[0].encode()] for i in range(len(b) - 5)}
    assert P.bins_for(df, "response") == 1 << (4 * len(grams) - 1).bit_length() < P.MOST_BINS
    found = {r["id"]: r["defect"] for r in P.defects(df, "id", "prompt", "response").collect()}
    assert all(found[str(i)] == "refusal" for i in range(6600, 6603)) and "refusal" not in [found.get(str(i)) for i in range(6600)]


def test_bins_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAST_BINS", 4)
    monkeypatch.setattr(P, "MOST_BINS", 64)
    for text, bins in (("", 4), ("abcdef", 4), ("abcdefgh", 16), ("".join(map(chr, range(40, 120))), 64)):
        assert P.bins_for(spark.createDataFrame([(text,), (text,), (None,)], "r string"), "r") == bins


def test_more_of_the_same_changes_no_score():
    said = [x for p in PROMPTS[:4] for x in P.sentences(p)] * 20 + GOOD * 20 + ["I'm sorry, but I can't help with the weir."] * 2
    one, many = P.Refusals(said), P.Refusals(said * 30, scale=30.0)
    for s in (*said[-3:], "I cannot help you with that.", "The pump cannot be moved."):
        assert many.score(s) == pytest.approx(one.score(s), rel=1e-9)
    assert one.declines(said[-1]) and many.declines(said[-1])
    assert (abs(P.Languages(PROMPTS * 30, 30.0).log - P.Languages(PROMPTS).log) < 1e-5).all()

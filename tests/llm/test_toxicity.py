import numpy as np
import pytest

from lodestack.llm import toxicity as tx
from lodestack.session import table


@pytest.mark.parametrize("text,words", [
    ("s c u m b a g, b o r n   t h i e v e s.", ["scumbag", "born", "thieves"]),
    ("he s.p.r.e.a.d her", ["he", "spread", "her"]),
    ("сlісk for blooowjobs", ["click", "for", "blowjobs"]),
    ("4brut1 c4m3 IMBÉCIIIIL", ["abruti", "came", "imbecil"]),
    ("水泵 ok テスト", ["水", "泵", "ok", "テ", "ス", "ト"]), ("x" * 300, ["x"]), ("ab" * 200, ["ab" * 200]),
    ("", []), (" \n​", []),
])
def test_words(text, words):
    assert tx.words_of(text) == words


def test_windows_cover_everything():
    for n in range(1, 80):
        got = {i for s in tx.windows(n) for i in range(s, min(n, s + tx.WINDOW))}
        assert got == set(range(n))
    assert tx.windows(0) == []


@pytest.mark.parametrize("word", ["disgusting", "x" + "worthless" * 9, "ab"])
def test_all_grams_of_a_word(word):
    cells, weights = tx.word_cells(word)
    edged = f"<{word}>"
    grams = {edged[i : i + n] for n in (3, 4) for i in range(len(edged) - n + 1)}
    assert {tx.hashed(g) for g in grams} | {tx.hashed(f"w {word}")} == set(cells) - {0}
    assert abs(sum(weights) - 2) < 1e-6
    v = tx.Vocabulary()
    v.add(["pump", word, "harbour"])
    want = np.array(weights) @ tx.Network(3).p["table"][cells]
    assert np.allclose(tx.Network(3).embed(*v.arrays())[1], want, atol=1e-6)


def test_gradients():
    rng = np.random.default_rng(0)
    net = tx.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    cells, weights = np.array([tx.word_cells(w)[0] for w in "abc abd hello".split()]), np.array([tx.word_cells(w)[1] for w in "abc abd hello".split()])
    ids = np.array([[0, 1, 2, 0, -1], [2, 2, 1, -1, -1], [1, 0, 0, 2, 1]])
    goal, scale = np.array([1.0, 0.0, 1.0]), np.ones(3)
    loss, g, _ = net.gradients(ids, cells, weights, goal, scale)
    for k in ("xf", "hb", "bf", "att", "query", "out", "bias", "hf"):
        at = tuple(rng.integers(0, n) for n in net.p[k].shape)
        old = net.p[k][at]
        ends = []
        for d in (1e-3, -1e-3):
            net.p[k][at] = old + d
            ends.append(net.gradients(ids, cells, weights, goal, scale)[0])
        net.p[k][at] = old
        assert abs((ends[0] - ends[1]) / 2e-3 - g[k][at]) < 2e-4, k


def test_held_out():
    rng = np.random.default_rng(1)
    fine = ["the pump was tested near the old harbour", "values for the turbine were recorded again", "the report gives nine hours for the weir"]
    bad = ["you are a worthless idiot and everyone knows", "go to hell you stupid moron", "i will smash your face in"]
    docs = [" ".join(rng.choice(fine, 6)) + (" " + str(rng.choice(bad)) + " " + str(rng.choice(fine)) if i % 3 == 0 else "") for i in range(500)]
    net, _ = tx.train(docs, np.array([int(i % 3 == 0) for i in range(500)]), epochs=3)
    v = tx.Vocabulary()
    new = [" ".join([fine[0], fine[1], b.upper()]) for b in bad] + [" ".join(fine), fine[2]]
    scores = [tx.score_windows(net, tx.window_matrix(v.add(tx.words_of(t))), *v.arrays()).max() for t in new]
    assert min(scores[:3]) > 0.6 > max(scores[3:])


def test_frames(spark, sf):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x " * 20000, None), (3, "x", "b")], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = tx.scored(docs, none, ["doc_id", "source"]).collect()
    assert len(got) == 4 and all(r["score"] == 0 and not r["flagged"] for r in got)
    labels = table(spark, sf, "doc_labels")
    small = tx.scored(table(spark, sf, "documents").select("doc_id", "text"), labels, ["doc_id"])
    assert small.count() == table(spark, sf, "documents").count()


def test_a_late_passage_of_a_long_judged_document_teaches():
    fine = [" ".join(f"w{(i * 7 + j) % 90}" for j in range(40)) for i in range(120)]
    bad = [" ".join(f"w{(i * 5 + j) % 90}" for j in range(1500)) + " you rotten scumbag go away" for i in range(40)]
    net, counts = tx.train(fine + bad, np.array([0] * 120 + [1] * 40))
    assert (counts == 0).any() and (counts > 1).any()
    v = tx.Vocabulary()
    m = tx.window_matrix(v.add(tx.words_of(bad[3])))
    got = tx.score_windows(net, m, *v.arrays())
    assert len(m) > tx.NEGATIVES and got.argmax() >= len(m) - 2 and got.max() > 0.5 > np.median(got)


def test_threshold_parts_hard_fine_documents():
    bins, toxic = np.array([0, 10, 11, 30, 34, 0]), np.array([0, 0, 0, 1, 1, 1])
    limit = tx.threshold(bins, toxic, np.array([900.0, 20, 10, 50, 100, 40]))
    at = lambda k: 1 / (1 + np.exp(-(tx.FIRST_CUT + tx.CUT_STEP * k)))
    assert at(10) < limit < at(30)
    assert tx.threshold(bins[:3], toxic[:3], np.ones(3)) == 0.5 and tx.threshold(bins[:0], toxic[:0], np.ones(0)) == 0.5


def test_rates_like_scores(spark, sf):
    got = {r["source"]: (r["n_docs"], r["n_flagged"]) for r in tx.p8_rates(spark, sf).collect()}
    rows = tx.p8_scores(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").collect()
    assert got == {s: (sum(r["source"] == s for r in rows), sum(r["source"] == s and r["flagged"] for r in rows)) for s in {r["source"] for r in rows}}
    assert tx.p8_found(spark, sf).count() == sum(r["flagged"] for r in rows)

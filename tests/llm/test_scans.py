import numpy as np
import pytest

from lodestack.llm import pages as G
from lodestack.llm import scans as S
from lodestack.llm.boosting import Boosted
from lodestack.session import table

PARAGRAPHS = [
    "The staff in the lower hall described every storage box in a separate appendix, and the visiting team signed the list of the station.",
    "From nine metres onwards the sediment behaved like a preliminary embankment, which had not been recorded since the flood of that year.",
    "Whether the rating curve should be confirmed depends on the irrigation line on the western slope and on the values of the gauge.",
] * 10


def test_boosted():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 5))
    y = (x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)
    model = Boosted(40, 3).fit(x[:2000], y[:2000])
    assert ((model.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    assert len(model.predict(x[:0])) == 0


def test_furniture_on_new_pages():
    furniture = G.Furniture(PARAGRAPHS, documents=120)
    rng = np.random.default_rng(99)
    right, wrong, lost = 0, 0, 0
    for _ in range(30):
        lines, labels = G.made_document(rng, PARAGRAPHS)
        for kind, label in zip(furniture.kinds(lines), labels):
            got, want = {"header": 1, "page_number": 2}.get(kind, 0), label
            right += got == want != 0
            wrong += got != want and got != 0
            lost += got != want and want != 0
    assert right / (right + wrong) > 0.85 and right / (right + lost) > 0.85
    assert furniture.kinds([]) == [] and furniture.kinds(["", " "]) == ["blank", "blank"]


@pytest.mark.parametrize("good,bad,known,other", [("clinic", "dinic", 1, 0), ("been", "beeri", 1, 0), ("report", "repor†", 1, 0), ("about", "abuot", 0, 1), ("same", "same", 0, 0)])
def test_alignment(good, bad, known, other):
    assert S.alignment(good, bad)[1:3] == (known, other)


def test_numbers():
    assert G.page_of("- 222 -") == (222, 3) and G.page_of("p. 2O/24")[0] == 20 and G.page_of("xliv")[0] == 44 and G.page_of("I42")[0] == 142
    assert G.page_of("36.5   54.9") is None and G.page_of("and 12 more words") is None
    assert G.chained([5, 9, 6, 3]) == [True, False, True, False]


def test_document_words():
    text = "A long-\nterm mea-\nsurement of 12 m, l'étude.\n- 7 -\nGauge QX-\n0012345 was s@lt-resistant."
    words, at, pairs, furniture = S.document_words(text.split("\n"), ["text", "text", "text", "page_number", "text", "text"])
    assert {p[:4] for p in pairs} == {(1, 2, "long", "term"), (2, 3, "mea", "surement"), (5, 6, "QX", "0012345")}
    assert furniture == [(4, "page_number")]
    assert {w for w, n in zip(words, at) if n > 0} == {"a", "of", "m", "étude", "gauge", "was", "s@lt-resistant"}
    assert {(w, n) for w, n in zip(words, at) if n < 0} == {("longterm", -1), ("measurement", -2), ("qx0012345", -5)}


def test_a_hyphen_past_many_running_lines():
    lines = ["The pump was mea-", *["- 7 -"] * 20, "sured twice."]
    pairs = S.document_words(lines, ["text", *["page_number"] * 20, "text"])[2]
    assert pairs[0][:4] == (1, 22, "mea", "sured")


def test_scans_are_told_by_all_lines():
    furniture = G.Furniture(PARAGRAPHS, documents=120)
    rng = np.random.default_rng(7)
    made = [G.damaged(rng, G.made_document(rng, PARAGRAPHS)[0]) for _ in range(60)]
    clean = [G.made_clean(rng, PARAGRAPHS) for _ in range(60)]
    kinds = furniture.read(["\n".join(x) for x in made + clean])
    assert sum(k is not None for k in kinds[:60]) >= 55 and sum(k is None for k in kinds[60:]) >= 57
    page = G.made_document(np.random.default_rng(2), PARAGRAPHS)[0]
    for at in (0, len(page) // 2):
        page[at] = page[at] + " and" * 60
    assert furniture.read(["\n".join(page)])[0] is not None
    assert furniture.read([]) == []


def test_candidates_lose_no_near_word(spark):
    rng = np.random.default_rng(1)
    draw = lambda n: "".join(rng.choice(list("abcde"), n))
    good = sorted({draw(int(n)) for n in rng.integers(3, 12, 150)})
    bad = []
    for w in good[:100]:
        for _ in range(2):
            i, kind = int(rng.integers(len(w))), int(rng.integers(3))
            w = (w[:i] + w[i + 1 :], w[:i] + draw(1) + w[i:], w[:i] + draw(1) + w[i + 1 :])[kind] or "a"
        bad.append(w)

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                before, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, before + (x != y))
        return d[-1]

    # Words of which nothing is sure to stay aren't promised.
    want = {(a, b) for a in set(bad) for b in good if a != b and distance(a, b) <= 2 and min(len(a), len(b)) >= 6}
    frames = [spark.createDataFrame([(w,) for w in ws], "word string") for ws in (sorted(set(bad)), good)]
    got = {(r["word"], r["cand"]) for r in S.candidate_pairs(*frames).collect()}
    assert want and want <= got


def test_repair():
    text = "Title line here\n\n   The pump was mea-\n- 12 -\nsured bcfore the winter and the weir was\nrepaired with care.\n"
    found = [{"line_no": 3, "kind": "hyphen"}, {"line_no": 4, "kind": "page_number"}, {"line_no": 5, "kind": "misread"}]
    fixes = [{"line_no": 5, "word": "bcfore", "right": "before"}]
    assert S.repair(text, found, fixes).split("\n")[-1] == "The pump was measured before the winter and the weir was repaired with care."
    assert S.repair("", [], []) == ""


def test_like_lines_of_a_long_document():
    rng = np.random.default_rng(5)
    made = lambda n: "".join(rng.choice(list("abcdfgklmnopqrstwxyz"), n))
    heads = [made(int(n)) for n in rng.integers(30, 110, 60)]
    groups = {h: [2 * i, 2 * i + 1] for i, h in enumerate(heads)}
    groups |= {made(50): [1000 + i] for i in range(600)}
    like = {h[:9] + "zz" + h[11:]: h for h in heads}
    groups |= {k: [5000 + i] for i, k in enumerate(like)}
    G._merge_like(groups)
    assert all(k == h or (k not in groups and 5000 + i in groups[h]) for i, (k, h) in enumerate(like.items()))
    assert len(groups) == 660


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "ekr_doc_full")
    found = S.analyse(docs, sample_docs=100, sample_words=800)
    kinds = {r["kind"]: r["n"] for r in found.lines.groupBy("kind").count().withColumnRenamed("count", "n").collect()}
    assert kinds.keys() == {"header", "page_number", "hyphen", "misread"}
    assert found.lines.count() == found.lines.distinct().count()


def scanned(rng, paragraphs, title):
    """A made scan: wrapped, divided words, running lines, page numbers and misread letters."""
    lines = []
    for p in paragraphs:
        line = ""
        for w in p.split():
            room = 58 - len(line)
            if len(w) > room:
                if len(w) > 7 and 3 < room < len(w) - 2:
                    lines.append(line + w[: room - 1] + "-")
                    line = w[room - 1 :] + " "
                    continue
                lines.append(line.rstrip())
                line = ""
            line += w + " "
        lines += [line.rstrip(), ""]
    out = []
    for page, lo in enumerate(range(0, len(lines), 22)):
        out += [title, *[G.misread(x, rng, 0.002) for x in lines[lo : lo + 22]], f"- {page + 3} -"]
    return "\n".join(out)


def test_repaired_text_against_its_source(spark):
    rng = np.random.default_rng(8)
    docs = table(spark, "/root/testdata/sf0.01", "ekr_doc_full").select("content").dropna().collect()
    pool = [p.strip() for r in docs for p in r["content"].split("\n") if len(p) > 200 and p.isascii()]
    rows, truth = [], {}
    for i in range(40):
        own = [pool[int(j)] for j in rng.integers(0, len(pool), 6)]
        truth[f"s{i}"] = own
        rows.append((f"s{i}", scanned(rng, own, f"Annual Survey of the {['Weir', 'Pump', 'Kiln', 'Loom'][i % 4]}"), None))
    rows += [(f"c{i}", "\n".join(pool[i * 5 : i * 5 + 5]), None) for i in range(len(pool) // 5)]
    df = spark.createDataFrame(rows, "id string, content string, update_time timestamp")
    got = {r["id"]: r["text"] for r in S.repaired(S.analyse(df, sample_docs=200, sample_words=1500)).collect()}
    put = sum(r[1].count("\n- ") + r[1].count("Annual") for r in rows if r[0][0] == "s")
    left = sum(got[i].count("- 3 -") + got[i].count("- 4 -") + got[i].count("Annual") for i in truth)
    assert left < 0.1 * put
    whole, words, right = 0, 0, 0
    for i, paragraphs in truth.items():
        flat = " ".join(got[i].split())
        for p in paragraphs:
            whole += p in flat
            words += len(p.split())
            right += sum(w in flat for w in p.split())
    assert whole / 240 > 0.7 and right / words > 0.98, (whole, right, words, left, put)
    assert all(got[r[0]] == r[1] for r in rows if r[0][0] == "c")


def test_nothing(spark):
    docs = spark.createDataFrame([("a", None, None), ("b", " \n", None)], "id string, content string, update_time timestamp")
    assert S.analyse(docs).lines.count() == 0

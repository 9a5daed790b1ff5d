import random

import pytest

from lodestack.llm import names as nm


def osa(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@pytest.mark.parametrize("d", [1, 2])
def test_automaton_like_brute_force(d):
    rng = random.Random(d)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(250)}
    trie = nm.build_trie((w, 1) for w in words)
    for word in list(words)[:60]:
        assert {w for w, _ in nm.neighbours(trie, word, d)} == {w for w in words if osa(word, w) <= d}


def test_shards_lose_no_pair():
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(4, 12)))
        i, kind = rng.randrange(len(a)), rng.randrange(4)
        b = (a[:i] + a[i + 1 :], a[:i] + rng.choice("abcd") + a[i:], a[:i] + rng.choice("abcd") + a[i + 1 :], a[:i] + a[i : i + 2][::-1] + a[i + 2 :])[kind]
        if a != b and min(len(a), len(b)) >= nm.MIN_WORD - 1:
            long, short = sorted((a, b), key=len, reverse=True)
            assert set(nm.shard_keys(long)[1]) & set(nm.shard_keys(short)[0]), (a, b)


def test_two_edits_lose_no_pair():
    rng = random.Random(4)
    for _ in range(3000):
        a = b = "".join(rng.choice("abcd") for _ in range(rng.randint(8, 30)))
        for _ in range(2):
            i, kind = rng.randrange(len(b)), rng.randrange(4)
            b = (b[:i] + b[i + 1 :], b[:i] + rng.choice("abcd") + b[i:], b[:i] + rng.choice("abcd") + b[i + 1 :], b[:i] + b[i : i + 2][::-1] + b[i + 2 :])[kind]
        if osa(a, b) <= 2:
            long, short = sorted((a, b), key=len, reverse=True)
            assert nm.deletions(a) & nm.deletions(b), (a, b)
            assert set(nm.shard_keys(long, 2)[1]) & set(nm.shard_keys(short, 2)[0]), (a, b)


def test_two_edits(spark):
    groups = [
        ["Julien Gimifazegan", "Gimifazegan, Julien", "J. Gimifazegan", "Julien Gimiphazegan"],
        ["Rosa Fypotefemok", "Fypotefemok, Rosa", "Rosa N. Fypotefemok", "Rosa Fypotephemok"],
        ["Ada " + "Norilyvimyt" * 3, "A. " + "Norilyvimyt" * 3, "Norilyvimyt" * 3 + ", Ada", "Ada Morilyvimyt" + "norilyvimyt" + "norilyvimyd"],
        ["Helmut Wituesudi", "Wituhsudi, Helmut", "Helmut Wituhesudi", "Helmut Wiituhesudi"],
    ]
    got = {(r["name_a"], r["name_b"]) for r in nm.variant_pairs(spark.createDataFrame([(n,) for g in groups for n in g], "name string")).collect()}
    assert got == {(a, b) for g in groups for a in g for b in g if a < b}


GROUPS = [
    ["Dimitri H. Rivybewurun", "Dimitri Rivybewurún", "Rivybewurun, Dimitri", "D. H. Rivybewurun", "Dimi. Rivybewurun", "DIMITRI RIVYBEWURUN", "Dimitri  Rivybewurnu"],
    ["Edward Rivybewurun", "Ted Rivybewurun", "E. Rivybewurun", "Rivybewurun Edward", "Prof. Dr. Edward Rivybewurun"],
    ["Cycydorate Museum of Bridge Safety", "Cycydorate MBS", "Museum of Bridge Safety, Cycydorate", "The Cycydorate Mus. of Bridge Safety (CMBS)", "Cycydorate Museum of Bridfe Safety"],
    ["Cycydorate and Brothers Manufacturing Company GmbH", "Cycydorate & Bros. Mfg Co. GmbH", "Cycydorate BMCG"],
    ["Cycydorate and Brothers Manufacturing Company AG", "Cycydorate and Brothers Manufacturing Company AG (CBMCA)"],
    ["University of Norilyvimyt", "Uni of Norilyvimyt", "university of norilyvimyt", "Univeristy of Norilyvimyt"],
]
ALONE = ["Gauge QX-0097239", "Gauge QX-0097238", "Lake Mirewozemi", "Upper Mirewozemi", "Rivybewurun Trial 1950", "Rivybewurun Trial 1951", "", "  ", "???", None, "x " * 400]


def test_found(spark):
    rows = [(n,) for g in GROUPS for n in g] + [(n,) for n in ALONE] + [(n,) for n in GROUPS[0]] + [(f"University of {x}",) for x in ("Colyluzeke", "Modywygurys", "Sofecorates")]
    got = {(r["name_a"], r["name_b"]) for r in nm.variant_pairs(spark.createDataFrame(rows, "name string")).collect()}
    assert got == {(a, b) for g in GROUPS for a in g for b in g if a < b}


def test_no_names(spark):
    assert nm.variant_pairs(spark.createDataFrame([(None,)], "name string")).count() == 0


def test_long_names_and_learnt_words(spark):
    long_name = "Norilyvimyt Institute for " + " ".join("abcdefghijklmnop"[i] * 3 + "olu" for i in range(14)) + " Research"
    places = ("Colyluzeke", "Modywygurys", "Sofecorates", "Rivybewurun")
    rows = [long_name, long_name.replace("Institute", "Inst."), "Genossenschaft Tivolek", "Genoss. Tivolek"]
    rows += [f"{w} {p}" for p in places for w in ("Genossenschaft", "Gnsst")]
    rows += ["Anna Bilomek", "Albert Bilomek", "A. Bilomek"]
    df = spark.createDataFrame([(r,) for r in rows], "name string")
    got = {(r["name_a"], r["name_b"]) for r in nm.variant_pairs(df).collect()}
    assert tuple(sorted(rows[:2])) in got
    assert all(tuple(sorted((f"Genossenschaft {p}", f"Gnsst {p}"))) in got for p in places)
    assert not any("A. Bilomek" in p for p in got)
    found = nm.ambiguous_names(nm.describe_all(df)).collect()
    assert ("A. Bilomek", {"anna bilomek", "albert bilomek"}) in [(r["name"], {r["entity_a"], r["entity_b"]}) for r in found]

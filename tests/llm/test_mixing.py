import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import mixing
from lodestack.session import table


def sized(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, key double")


def brute(rows, targets, total):
    size = {}
    for _, s, n, _ in rows:
        size[s] = size.get(s, 0) + n
    feasible = [m * size[s] / t for s, t, m in targets if t > 0 and m > 0 and size.get(s)]
    total = total if total is not None else min(feasible)
    out = {}
    for s, t, m in targets:
        if not size.get(s):
            continue
        budget = min(m * size[s], t * total)
        epochs = math.floor(budget / size[s])
        rest, done = budget - epochs * size[s], 0
        for doc, _, n, _ in sorted((r for r in rows if r[1] == s and r[2] > 0), key=lambda r: (r[3], r[0])):
            more = done < rest and (done + n <= rest or done + n - rest < rest - done)
            done += n
            if epochs + more:
                out[doc] = epochs + more
    return out


def test_like_brute_force(spark):
    rows = [(i, "abcx"[i * i % 4] if i % 9 else None, i % 7 * 10, (i * 37 % 101) / 13) for i in range(400)]
    rows += [(1000 + i, "hot", 5, (i % 3) / 2) for i in range(300)]
    targets = [("a", 0.2, 3), ("b", 0.4, 2), ("hot", 0.2, 1), ("none", 0.1, 4), ("c", 0.1, 0)]
    cfg = spark.createDataFrame(targets, "source string, target_share double, max_repeat int")
    for total in (None, 500, 100_000):
        got = {r["doc_id"]: r["copies"] for r in mixing.mix(sized(spark, rows), cfg, total).collect()}
        assert got == brute([r for r in rows if r[1]], targets, total)


def test_whole_table(spark, sf):
    rows = {r["source"]: r for r in mixing.p7_shares(spark, sf).collect()}
    caps = {r["source"]: r for r in table(spark, sf, "mix_targets").collect()}
    assert rows.keys() == caps.keys()
    for source, r in rows.items():
        assert r["most_copies"] <= caps[source]["max_repeat"]
    assert abs(sum(r["actual_share"] for r in rows.values()) - 1) < 1e-9


def test_nothing(spark):
    cfg = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeat int")
    assert mixing.mix(sized(spark, []), cfg).count() == 0
    assert mixing.mix(sized(spark, [(1, "a", 0, 1.0), (2, None, 5, 1.0)]), cfg).count() == 0
    got = mixing.shares(mixing.mix(sized(spark, []), cfg), cfg).collect()
    assert got[0]["tokens"] == 0 and got[0]["actual_share"] == 0


def test_one_target_of_no_repeats_leaves_the_others(spark):
    rows = [(i, "ab"[i % 2], 10, i / 7) for i in range(200)]
    cfg = spark.createDataFrame([("a", 0.5, 0), ("b", 0.5, 1)], "source string, target_share double, max_repeat int")
    got = mixing.mix(sized(spark, rows), cfg).collect()
    assert len(got) == 100 and {r["source"] for r in got} == {"b"}
    twice = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 1)], "source string, target_share double, max_repeat int")
    with pytest.raises(ValueError, match="twice"):
        mixing.mix(sized(spark, rows), twice).count()


def test_ranges_do_not_matter(spark, monkeypatch):
    rows = [(i, "abc"[i % 3], i % 7 * 10, (i * 37 % 101) / 13) for i in range(400)]
    cfg = spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 2)], "source string, target_share double, max_repeat int")
    want = sorted(mixing.mix(sized(spark, rows), cfg, 3000).collect())
    monkeypatch.setattr(mixing, "RANGE_ROWS", 1)
    monkeypatch.setattr(mixing, "LEAST_RANGES", 3)
    assert sorted(mixing.mix(sized(spark, rows), cfg, 3000).collect()) == want


def test_quality_is_learnt():
    words = "the values for pump weir were described in report of station and harbour were recorded twice before noon".split()
    rng = np.random.default_rng(0)
    prose = [" ".join(rng.choice(words, 20)) for _ in range(300)]
    q = mixing.Quality(prose)
    good, bad, empty = q.weights(["the values for the weir were described in the report of the pump", "#x9|@@ 0x7f;;;{]] %%%", None])
    assert good > 0.5 > 0.1 > bad >= mixing.LEAST_WEIGHT == empty
    assert np.isfinite(q.weights(["", "ab", "x" * 100_000, "\ud800 odd"])).all()


def test_given_weights(spark, sf):
    docs = table(spark, sf, "documents")
    a = mixing.sized_documents(docs, weight=F.when(F.col("doc_id") % 2 == 0, 5.0).otherwise(F.lit(None)))
    mean = {r["odd"]: r["k"] for r in a.groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg("key").alias("k")).collect()}
    assert mean[0] * 10 < mean[1]


def test_shares_like_the_mixture(spark, sf):
    mixed = mixing.p7_mix(spark, sf).collect()
    whole = sum(r["copies"] * r["n_tokens"] for r in mixed)
    for r in mixing.p7_shares(spark, sf).collect():
        own = [x for x in mixed if x["source"] == r["source"]]
        assert (r["n_docs"], r["tokens"]) == (len(own), sum(x["copies"] * x["n_tokens"] for x in own))
        assert abs(r["actual_share"] - r["tokens"] / whole) < 1e-12


def test_quality_comes_from_all_documents(spark):
    """More documents than the former sample of 4,000; rare ones count too."""
    texts = [f"the values for pump {i % 97} were recorded twice" for i in range(5200)] + [f"zq{i:04d}" for i in range(0, 900, 3)] + ["", None, "ab"]
    docs = spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    want, got = mixing.Quality([t for t in texts if t]), mixing.fitted_quality(docs)
    assert got.pairs.sum() == sum(len(t) - 2 for t in texts if t and len(t) > 2)
    assert (got.pairs == want.pairs).all() and (got.triples == want.triples).all()
    keys = {r["doc_id"]: r["key"] for r in mixing.sized_documents(docs).collect()}
    u = {r["doc_id"]: r["u"] for r in docs.select("doc_id", mixing.uniform(0, "doc_id").alias("u")).collect()}
    assert len(keys) == len(texts)
    for i, w in enumerate(want.weights(texts)):
        assert keys[i] == pytest.approx(-math.log(u[i]) / w, rel=1e-9)


def test_middle_and_spread():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100):
        x = np.round(rng.normal(size=n), 1)
        values, times = np.unique(x, return_counts=True)
        middle, spread = mixing.middle_and_spread([*values, math.nan], [*times, 5])
        assert middle == np.median(x) and spread == pytest.approx(max(0.1, 1.4826 * np.median(np.abs(x - np.median(x)))))
    assert mixing.middle_and_spread([], []) == (0.0, 0.1)

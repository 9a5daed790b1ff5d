import numpy as np

from lodestack.llm import neighbours as nb


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, content_vector array<float>")


def brute(rows, k):
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    ids = [i for i, _ in rows]
    return {tuple(sorted((ids[a], ids[b]))) for a in range(len(ids)) for b in np.argsort(-s[a], kind="stable")[:k]}


def test_recall_and_cases(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((60, 8))
    rows = [(f"r{i:04d}", (centres[i % 60] + 0.3 * rng.standard_normal(8)).tolist()) for i in range(1500)]
    bad = [("n0", None), ("n1", [0.0] * 8), ("n2", [1.0] * 7), ("n3", [float("nan")] + [1.0] * 7), (None, [1.0] * 8), rows[0], rows[1]]
    got = nb.similar_pairs(frame(spark, rows + bad), dim=8, k=5, leaf_rows=100, probes=6).collect()
    pairs = {(r["id_a"], r["id_b"]) for r in got}
    want = brute(rows, 5)
    assert len(got) == len(pairs) and all(a < b for a, b in pairs)
    assert len(pairs & want) / len(want) > 0.9 and len(pairs & want) / len(pairs) > 0.9
    assert not any(x.startswith("n") for p in pairs for x in p)


def test_recall_grows_with_the_table(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((200, 32))
    rows = [(f"r{i:05d}", (centres[i % 200] + 0.8 * rng.standard_normal(32)).tolist()) for i in range(6000)]
    got = nb.similar_pairs(frame(spark, rows), dim=32, leaf_rows=50).collect()
    pairs = {(r["id_a"], r["id_b"]) for r in got}
    assert len(pairs & brute(rows, 10)) / len(brute(rows, 10)) > 0.9


def test_copies(spark):
    rng = np.random.default_rng(1)
    hot = rng.standard_normal(8)
    rows = [(f"c{i:03d}", hot.tolist()) for i in range(40)] + [(f"x{i:03d}", rng.standard_normal(8).tolist()) for i in range(20)]
    pairs = {(r["id_a"], r["id_b"]) for r in nb.similar_pairs(frame(spark, rows), dim=8, k=3, leaf_rows=1000).collect()}
    for i in range(40):
        assert sum(f"c{i:03d}" in p for p in pairs) >= 3
    assert len([p for p in pairs if p[0][0] == p[1][0] == "c"]) <= 40 * 3 + 10
    assert all(sum(f"x{i:03d}" in p for p in pairs) >= 3 for i in range(20))


def test_few_rows(spark):
    assert nb.similar_pairs(frame(spark, [("a", [1.0, 0.0]), ("b", [1.0, 0.1])]), dim=2, k=3).collect()[0]["id_a"] == "a"
    assert nb.similar_pairs(frame(spark, [("a", None)]), dim=2, k=3).count() == 0


def test_defaults_at_64_dimensions_and_split_leaves(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((100, 64))
    rows = [(f"r{i:05d}", (centres[i % 100] + 0.7 * rng.standard_normal(64)).tolist()) for i in range(5000)]
    want = brute(rows, 10)
    got = {(r["id_a"], r["id_b"]) for r in nb.similar_pairs(frame(spark, rows)).collect()}
    assert len(got & want) / len(want) > 0.93
    monkeypatch.setattr(nb, "LEAF_MOST", 150)
    assert {(r["id_a"], r["id_b"]) for r in nb.similar_pairs(frame(spark, rows)).collect()} == got
    exact = {(r["id_a"], r["id_b"]) for r in nb.similar_pairs(frame(spark, rows), exact=True).collect()}
    assert len(exact & want) / len(want) > 0.9999

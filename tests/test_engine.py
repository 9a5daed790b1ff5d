import json
import sys
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.engine import Engine
from lodestack.functions import text as T
from lodestack.operators import ann, chunking, context, extraction, graph, maintenance, resolve, search, services, summaries
from lodestack.operators import strategies as st
from lodestack.sources import files, stores
from lodestack.sources.catalog import Catalog, Conflict, export
from lodestack.streaming import ingest


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("bad", "<|##|> <|#||#|> <|#|||#|> <|\\#|> <|> <||> <X|#|> <|#|Y> <X|#|Y> <||#||> <#> <#|> <|#> <X#|> <|#X> <|#| <|#|| <|#: <||#> <|| |#|> <|#|>| ||#|| <|#|>".split())
def test_delimiters(spark, bad):
    assert one(spark, T.repaired_delimiters("a"), a=f"entity{bad}Xy{bad}z") == "entity<|#|>Xy<|#|>z"


def test_prose_has_no_delimiters(spark):
    for text in ("a <> b < c > d <b> <a#b> x|y", "", "#1 <|im_start|>"):
        assert one(spark, T.repaired_delimiters("a"), a=text) == text


def test_text_functions(spark):
    assert one(spark, T.sanitize("a"), a=" a&#65;&#x1F600;b &lt;x&gt; &amp;amp; \x01z\n") == "aA😀b <x> &amp; z"
    assert one(spark, T.sanitize("a"), a="caf&eacute; &notaname; &hearts; &#233;&#x1F600; R&D;") == "café &notaname; ♥ é😀 R&D;"
    assert one(spark, T.decoded_escapes("a"), a='x\\u00e9 "q" \\n \\ud83d\\ude00 \\d\n') == 'xé "q" \\n 😀 \\d\n'
    assert one(spark, T.cleaned_pdf("a"), a="Article $^ { 16 ; }$ ▌b  c <sup>2</sup>") == "Article 16; b c <sup>2</sup>"
    names = {' "a  b" ': "a  b", '"AB" c': '"AB" c', '"ab"': "ab", "<p>《x y》</p>": "x y", "中 文 abc 中": "中文abc中", "12": "", "123": "123", "1.2": "", "Ａ（b）—c": "A(b)-c", "<br/>x": "x"}
    for raw, want in names.items():
        assert one(spark, T.extracted_name("a"), a=raw) == want, raw
    assert one(spark, T.extracted_name("a", True), a="“中\"文”\u00a0x") == "中文 x"
    lists = {'["a","b"]': ["a", "b"], '```json\n["a"]\n```': ["a"], '{"q":["x"]}': ["x"], "- one\n2. two\n": ["one", "two"], "": []}
    for raw, want in lists.items():
        assert one(spark, T.string_list("a", "q"), a=raw) == want, raw
    assert one(spark, T.without_echo("a", "b", "c"), a="P Q hello user", b="P", c="Q") == "hello user"
    assert one(spark, T.epoch_text("a"), a=0) == "1970-01-01 00:00:00" and one(spark, T.limit_method("a"), a=" keep") == "KEEP" and one(spark, T.limit_method("a"), a="x") == "FIFO"
    assert [m["role"] for m in one(spark, T.messages("a", "b"), a="q", b="r")] == ["user", "assistant"]
    ids = [r["x"] for r in spark.range(3).select(T.track_id("insert", F.current_timestamp()).alias("x")).collect()]
    assert len(set(ids)) == 3 and all(i.startswith("insert_") for i in ids)


def test_joined_and_nameless_records(spark):
    text = "entity<|#|>A<|#|>Person<|#|>First.<|#|>entity<|#|>B<|#|>Org<|#|>Second.<|#|>relationship<|#|>A<|#|>B<|#|>works<|#|>At B.\nC<|#|>Place<|#|>Third.<|complete|>\nplain words"
    parsed = extraction.records(spark.createDataFrame([("1", text)], "id string, r string"), "r", ["id"])
    assert sorted((r["name"], r["type"]) for r in extraction.entities(parsed, ["id"]).collect()) == [("A", "person"), ("B", "org"), ("C", "place")]
    assert [(r["src"], r["tgt"]) for r in extraction.relations(parsed, ["id"]).collect()] == [("A", "B")]


def test_context_lines(spark):
    df = spark.createDataFrame([(1, 1, 'a "b"', 163, "text", "E1", "E2", "law", "d")], "query_id int, ref int, h string, page int, content string, s string, t string, k string, d string")
    r = df.select(context.chunk_block("ref", "content", "page", "h").alias("c"), context.entity_line("s", "k", "d").alias("e"), context.relation_line("s", "t", "d").alias("r")).first()
    assert r["c"] == "<chunk reference_id=\"1\" page=\"163\" heading=\"a 'b'\">\ntext\n</chunk>" and r["e"] == "- E1 (law): d" and r["r"] == "- E1 <-> E2: d"


def test_split_then_window(spark):
    df = spark.createDataFrame([("d", "intro one two\n## A b c d e f g h\n## x", [5, 100])], "id string, c string, e array<int>")
    rows = chunking.split_then_window(df, "c", "## ", 4, 1, "e").collect()
    assert [(r["n_tokens"], r["content"], r["page_start"]) for r in rows] == [(3, "intro one two", 1), (4, "a b c d", 1), (4, "d e f g", 2), (2, "g h", 2), (1, "## x", 2)]
    with pytest.raises(Exception, match="more than 4 words"):
        chunking.split_then_window(df, "c", "## ", 4, 1, "e", only=True).collect()


def brute_pagerank(edges, anchors, rounds=300):
    names = sorted({x for e in edges for x in e[:2]} | set(anchors))
    at = {n: i for i, n in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for a, b, v in edges:
        w[at[a], at[b]] += v
        w[at[b], at[a]] += v
    p = np.array([10.0 if n in anchors else 1.0 for n in names])
    p /= p.sum()
    total = w.sum(1)
    r = p.copy()
    for _ in range(rounds):
        r = 0.15 * p + 0.85 * (p * r[total == 0].sum() + w.T @ np.divide(r, total, out=np.zeros_like(r), where=total > 0))
    return dict(zip(names, r))


def make_store(spark):
    embed = services.hash_embed(32)
    texts = {f"c{i}": t for i, t in enumerate(["alpha beta pump", "weir flood pump", "harbour crane", "crane weir station", "gamma delta"])}
    labels = ["pump", "weir", "crane", "harbour", "alone"]
    edges = [("pump", "weir", 2.0), ("crane", "harbour", 1.0), ("crane", "weir", 3.0), ("harbour", "pump", 1.0)]
    vec = lambda xs: embed(xs).tolist()
    frame = spark.createDataFrame
    chunks = frame([(c, t, "a.pdf" if i < 3 else "b.pdf", "d", i, i + 40, None) for i, (c, t) in enumerate(texts.items())],
                   "chunk_id string, content string, file_path string, full_doc_id string, chunk_order_index int, page_start int, heading string")
    e = [(min(a, b), max(a, b), w, f"{a} and {b}") for a, b, w in edges]
    return st.Store(
        frame(list(zip(labels, vec(labels))), "label string, embedding array<float>"), frame([(a, b, v) for (a, b, _, _), v in zip(e, vec([f"{x[0]} {x[1]}" for x in e]))], "src string, tgt string, embedding array<float>"),
        frame(list(zip(texts, vec(list(texts.values())))), "chunk_id string, embedding array<float>"), frame([(x, "thing", f"the {x}") for x in labels], "label string, type string, description string"),
        frame(e, "src string, tgt string, weight double, description string"), chunks,
        frame([("pump", "c0", 1), ("pump", "c1", 2), ("weir", "c1", 2), ("crane", "c3", 4)], "label string, chunk_id string, ord bigint"),
        frame([("crane", "weir", "c3", 4), ("crane", "harbour", "c2", 3)], "src string, tgt string, chunk_id string, ord bigint"),
    ), edges


def test_smart_edges_like_brute_force(spark):
    store, edges = make_store(spark)
    hits = spark.createDataFrame([(1, "pump", 1), (1, "alone", 2), (1, "weir", 3), (2, "crane", 1)], "query_id bigint, label string, rank bigint")
    got = {(r["query_id"], r["src"], r["tgt"]): r["smart_rank"] for r in st.smart_edges(store, hits).collect()}
    for q, anchors in ((1, {"pump", "alone", "weir"}), (2, {"crane"})):
        local = [e for e in edges if anchors & set(e[:2])]
        ranks = brute_pagerank(local, anchors)
        for a, b, _ in local:
            want = (ranks[a] + ranks[b]) * (2 if {a, b} <= anchors else 1)
            assert abs(got.pop((q, min(a, b), max(a, b))) - want) < 1e-9
    assert not got


def test_vector_pick_embeds_what_lacks(spark):
    store, _ = make_store(spark)
    store.chunk_vectors = spark.createDataFrame([("c0", [1.0, 0.0]), ("c1", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    related = spark.createDataFrame([(1, c, 1, 1, 1, 1) for c in ("c0", "c1", "c2")], "query_id bigint, chunk_id string, item_rank bigint, pos bigint, frequency bigint, n_items bigint")
    asked = []

    def embed(df):
        asked.extend(r["chunk_id"] for r in df.collect())
        return df.select("chunk_id", F.array(F.lit(0.7), F.lit(0.7)).cast("array<float>").alias("embedding"))

    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, query array<float>")
    got = st.picked_by_vector(related, store, queries, st.Options(max_related=4, embed=embed)).orderBy("rank").collect()
    assert asked == ["c2"] and [r["chunk_id"] for r in got] == ["c0", "c2"]
    none = st.picked(related, store, queries.select("query_id", F.array(F.lit(1.0)).cast("array<float>").alias("query")), st.Options(max_related=2))
    assert none.count() == 2


def test_engine(spark):
    store, _ = make_store(spark)
    asked = []
    engine = Engine(spark, store, services.hash_embed(32), 32, services.Model(lambda ps: [f"answer to {len(p)}" for p in ps], batch=4), st.Options(top_k=3, chunk_top_k=3))
    for mode in st.MODES:
        result = engine.query_data(["pump weir"], mode, rerank=search.overlap_score if mode == "hybrid_mix" else None)
        if mode == "bypass":
            assert result.contexts is None
            continue
        text = result.contexts.first()["context"]
        assert 'page="4' in text and "reference_id=" in text
        assert (mode == "naive") == (result.found.entities is None)
    with pytest.raises(ValueError, match="unknown mode"):
        engine.retrieve(["x"], "fuzzy")
    first = engine.query(["pump", "crane"], "naive").collect()
    assert {r["query_id"] for r in first} == {0, 1} and all(r["response"].startswith("answer") for r in first)
    n = engine.cache.count()
    assert engine.query(["pump", "crane"], "naive").count() == 2 and engine.cache.count() == n
    assert engine.query_llm(["pump"], "bypass", call=lambda ps: ["other"] * len(ps)).responses.first()["response"] == "other"
    engine.clear_cache(["query"])
    assert engine.cache.count() == 0
    assert [r["label"] for r in engine.labels().collect()] == ["alone", "crane", "harbour", "pump", "weir"]
    nodes, edges, more = engine.subgraph("pump", 1)
    assert nodes.count() == 3 and edges.count() == 2 and not more
    assert engine.subgraph("*", most=2)[2] and engine.subgraph("pump", 3, 2)[0].count() == 2
    with pytest.raises(ValueError, match="model"):
        Engine(spark, store, services.hash_embed(32), 32).query(["x"], "naive").count()


def test_parts_keywords_and_hypotheses(spark):
    store, _ = make_store(spark)

    def model(prompts):
        out = []
        for p in prompts:
            if p.startswith(services.DECOMPOSE):
                out.append('Sure: ["pump?", "crane?"]' if "both" in p else "")
            elif p.startswith(services.KEYWORDS):
                out.append('```json\n{"high_level_keywords": ["water"], "low_level_keywords": ["pump"]}\n```' if "pump" in p else "nothing")
            else:
                out.append("a passage on the weir")
        return out

    engine = Engine(spark, store, services.hash_embed(32), 32, services.Model(model, batch=2), st.Options(top_k=2, chunk_top_k=2))
    parts = engine.query_parts(["both"], "naive").collect()
    assert {r["question_id"] for r in parts} == {0} and sorted(r["position"] for r in parts) == list(range(1, len(parts) + 1))
    words = {r["query_id"]: (r["high"], r["low"]) for r in engine.keywords(["the pump", "crane"]).collect()}
    assert words == {0: (["water"], ["pump"]), 1: ([], ["crane"])}
    got = engine.vectors(engine.questions(["x"]), hyde=True).first()["query"]
    assert np.allclose(got, services.hash_embed(32)(["a passage on the weir"])[0], atol=1e-6)
    assert engine.retrieve(["x"], "naive", hyde=True).chunks.count() == 2


def test_extract_with_a_second_pass(spark):
    chunks = spark.createDataFrame([("k1", "text one"), ("k2", "text two")], "chunk_id string, content string")

    def model(prompts):
        return ["entity<|#|>B<|#|>t<|#|>new\nentity<|#|>A<|#|>t<|#|>a longer one<|COMPLETE|>" if services.GLEAN in p else "entity<|#|>A<|#|>t<|#|>short\nrelation<|#|>A<|#|>B<|#|>k<|#|>d<|COMPLETE|>" for p in prompts]

    cache = spark.createDataFrame([], "id string, return_value string")
    ents, rels, new = services.extractions(chunks, cache, services.Model(model))
    got = {(r["chunk_id"], r["name"]): r["description"] for r in ents.collect()}
    assert got == {(c, n): d for c in ("k1", "k2") for n, d in (("A", "a longer one"), ("B", "new"))}
    assert rels.count() == 2 and new.count() == 4
    assert services.extractions(chunks, new.select("id", "return_value"), services.Model(lambda ps: 1 / 0))[0].count() == 4


def test_models(spark, tmp_path):
    tries = tmp_path / "tries"
    tries.write_text("")

    def shaky(prompts):
        tries.write_text(tries.read_text() + "x")
        if len(tries.read_text()) < 3:
            raise OSError("busy")
        return [p.upper() for p in prompts]

    model = services.Model(shaky, wait=0.01, retries=5, at_once=1)
    assert services.insistent(model, ["a"]) == ["A"] and len(tries.read_text()) == 3
    with pytest.raises(OSError):
        services.insistent(services.Model(lambda p: (_ for _ in ()).throw(OSError("no")), retries=1, wait=0.01), ["a"])
    assert services.overridden(model, None) is model and services.overridden(model, len).call is len
    assert services.bound_options(model, {"LLM_AT_ONCE": "9", "LLM_WAIT": "2.5", "LLM_RETRIES": "x"}, "llm_").at_once == 9
    assert services.payload("m", "q", ["a", "b", "c"], None, {"x": 1}) == {"model": "m", "query": "q", "documents": ["a", "b", "c"], "top_n": 3, "x": 1}
    calls = services.Calls(spark)
    prompts = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "id string, prompt string")
    services.cached_calls(prompts, spark.createDataFrame([], "id string, return_value string"), lambda p: p, "d", "q", calls)
    assert calls.counts()["llm_call"] == 2 and calls.counts()["llm_cache"] == 0
    for _ in range(2):
        calls.append_csv(str(tmp_path / "usage"))
    assert spark.read.option("header", True).csv(str(tmp_path / "usage")).count() == 2
    other = prompts.withColumn("system", F.lit("be brief"))
    a, b = (services.cached_calls(p, spark.createDataFrame([], "id string, return_value string"), lambda p: p, "d", "q")[1] for p in (prompts, other))
    assert a.join(b, "id").count() == 0
    pages = spark.createDataFrame([("d", 1, "text", ["i.png"]), ("d", 2, "more", [])], "id string, page_number int, content string, images array<string>")
    got = services.with_image_texts(pages, spark.createDataFrame([], "id string, return_value string"), services.Model(lambda p: ["a pump"] * len(p)))[0]
    assert {r["content"] for r in got.collect()} == {"text\na pump", "more"}


def test_vector_tables(spark):
    old = spark.createDataFrame([("a", "old", [0.0, 0.0])], "id string, content string, vector array<float>")
    rows = spark.createDataFrame([("a", "new"), ("b", "more")], "id string, content string")
    got = {r["id"]: (r["content"], len(r["vector"])) for r in services.vector_upsert(old, rows, "content", services.hash_embed(8), 8).collect()}
    assert got == {"a": ("new", 8), "b": ("more", 8)}
    counts = services.counted_tokens(rows, "content", lambda texts: [len(t) for t in texts])
    assert {r["id"]: r["n_tokens"] for r in counts.collect()} == {"a": 3, "b": 4}


def test_rerank_seam(spark):
    df = spark.createDataFrame([(1, 1, "q", "low"), (1, 2, "q", "high"), (1, 3, "q", "mid"), (2, 1, "broken", "x"), (2, 2, "broken", "y")], "query_id int, rank int, q string, c string")

    def score(question, contents, top_n):
        if question == "broken":
            raise TimeoutError
        return [(i, {"low": 0.1, "high": 0.9, "mid": 0.5}[c]) for i, c in enumerate(contents)]

    got = services.rerank_column(df, "q", "c", score).withColumnRenamed("rerank_score", "given")
    best = search.reranked(got, F.col("given"), 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["c"]) for r in best] == [(1, "high"), (1, "mid"), (2, "x"), (2, "y")]


def greedy(items, limit):
    groups, now, tokens = [], [], 0
    for d in items:
        n = len(d) / 4
        if tokens + n > limit and now:
            if len(now) == 1:
                groups.append(now + [d])
                now, tokens = [], 0
            else:
                groups.append(now)
                now, tokens = [d], n
        else:
            now.append(d)
            tokens += n
    return groups + ([now] if now else [])


def test_summaries(spark):
    rng = np.random.default_rng(0)
    rows = [(i, ["x" * int(n) for n in rng.integers(1, 60, int(rng.integers(1, 14)))]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, d array<string>")
    for r in df.select("i", "d", summaries.greedy_groups(F.col("d"), 12.0).alias("g")).collect():
        assert r["g"] == greedy(r["d"], 12.0)
    many = [("one", "only", 1)] + [("few", f"part {i}", i) for i in range(3)] + [("many", f"a long description number {i} " * 5, i) for i in range(40)]
    items = spark.createDataFrame(many, "name string, description string, ord int")

    def ask(df):
        return services.asked(df, services.Model(lambda ps: [f"short {len(p)}" for p in ps], batch=8))

    got = {r["name"]: (r["summary"], r["used_model"]) for r in summaries.summarised(items, ask, context=150.0).collect()}
    assert got["one"] == ("only", False) and got["few"] == ("part 0<SEP>part 1<SEP>part 2", False) and got["many"][1] and "short" in got["many"][0]


def test_lists_around_centres(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 16))
    x = centres[np.arange(1500) % 20] + 0.4 * rng.standard_normal((1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    lists = ann.fitted(df, "v")
    index = ann.indexed(df, "v", lists)
    assert index.count() == 1503 and index.filter("list = -1").count() == 3
    queries = df.filter("id % 20 = 0 AND id < 1500").select(F.col("id").alias("query_id"), F.col("v").alias("query"))
    got = {(r["query_id"], r["id"]) for r in ann.search(index, lists, queries, "id", "v", 10, 8).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, int(i)) for q in range(0, 1500, 20) for i in np.argsort(-(unit[q] @ unit.T))[:10]}
    assert len(got & want) / len(want) > 0.9


def test_dense_like_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 5)).round(1)
    rows = [(f"k{i % 290:03d}-{i}", v.tolist()) for i, v in enumerate(x)] + [(f"t{i}", [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)] + [("z", [0.0] * 5), ("n", None), ("s", [1.0]), ("m", [None, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "k string, v array<double>").repartition(5)
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 0.0]), (2, [1.0, 2.0, 3.0, 4.0, 5.0]), (3, [0.0] * 5), (4, [2.0])], "query_id bigint, query array<double>")
    got = search.dense(df, queries, "k", "v", 12).collect()
    for q, v in ((1, [1.0, 0, 0, 0, 0]), (2, [1.0, 2, 3, 4, 5])):
        all_ = sorted((-round(float(np.dot(v, y) / np.linalg.norm(v) / np.linalg.norm(y)), 12), k) for k, y in rows if y and len(y) == 5 and None not in y and any(y))[:12]
        assert [r["k"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [k for _, k in all_]
    assert {r["query_id"] for r in got} == {1, 2, 4}


def test_bm25_floor_and_absent_terms(spark):
    docs = spark.createDataFrame([(1, "the pump the weir"), (2, "the crane"), (3, ""), (4, None), (5, "the pump")], "id int, t string")
    asked = spark.createDataFrame([(1, "the"), (1, "pump"), (1, "pump"), (2, "absent")], "query_id bigint, term string")
    rows = search.bm25(docs, asked, "id", "t", 5).collect()
    assert {r["query_id"] for r in rows} == {1} and rows[0]["score"] > 0
    assert search.bm25(docs.limit(0), asked, "id", "t", 5).count() == 0


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")).repartition(7)
    assert all(r["n"] == r["v"] + 1 for r in search.numbered(df, ["v"], "n").collect())


def test_a_hub_of_many_sources(spark):
    hub = spark.range(300_000).select(F.lit("hub").alias("name"), F.lit("t").alias("type"), F.concat(F.lit("d"), F.col("id")).alias("description"), F.concat(F.lit("c"), F.col("id")).alias("source_id"), F.lit("f").alias("file_path"), F.col("id").alias("ord"))
    r = resolve.merge_nodes(hub, 300).first()
    assert len(r["source_ids"]) == 300 and r["source_ids"][-1] == "c299999" and r["file_paths"] == ["f"]
    assert resolve.merge_nodes(hub, 300, "KEEP").first()["source_ids"][0] == "c0"


def test_edits(spark):
    nodes = spark.createDataFrame([("a", "t", "d1", "s1"), ("b", "t", "d2", "s2"), ("c", None, None, None)], "label string, type string, description string, source_id string")
    edges = spark.createDataFrame([("a", "b", 1.0, "x", "k2, k1", "s1"), ("a", "c", 2.0, "y", "k1", "s1"), ("b", "c", 5.0, "z", "k3", "s2")], "src string, tgt string, weight double, description string, keywords string, source_id string")
    names = spark.createDataFrame([("b", "a")], "label string, target string")
    with pytest.raises(ValueError, match="already"):
        maintenance.renamed_entities(nodes, edges, names)
    n, e = maintenance.renamed_entities(nodes, edges, names, allow_merge=True)
    assert {r["label"]: (r["description"], r["source_id"]) for r in n.collect()} == {"a": ("d1<SEP>d2", "s1<SEP>s2"), "c": ("", "")}
    assert [tuple(r) for r in e.collect()] == [("a", "c", 5.0, "y<SEP>z", "k1,k3", "s1<SEP>s2")]
    with pytest.raises(ValueError, match="entity a"):
        maintenance.created_entities(nodes, nodes.limit(1))
    new = spark.createDataFrame([("c", "zz", 1.0, "", "", "")], edges.schema)
    with pytest.raises(ValueError, match="no entity zz"):
        maintenance.created_relations(nodes, edges, new)
    with pytest.raises(ValueError, match="a and b"):
        maintenance.created_relations(nodes, edges, edges.limit(1))
    assert graph.bounded_search(edges, "nowhere", 2, 5).count() == 0


def test_delete_documents(spark):
    frame = spark.createDataFrame
    rec = maintenance.Records(
        frame([("A", "t", "a1", "c1", "f", 1), ("A", "t", "a2", "c2", "f", 2), ("B", "t", "b1", "c1", "f", 1), ("C", "t", "c", "c2", "f", 2)], "name string, type string, description string, chunk_id string, file_path string, ord bigint"),
        frame([("A", "B", 1.0, "k", "r", "c1", "f", 1), ("A", "C", 1.0, "k", "r1", "c1", "f", 1), ("A", "C", 1.0, "k2", "r2", "c2", "f", 2)], "src string, tgt string, weight double, keywords string, description string, chunk_id string, file_path string, ord bigint"))
    nodes, edges = maintenance.built(rec)
    tables = {
        "full_docs": frame([("w", "d1"), ("w", "d2")], "workspace string, id string"), "doc_status": frame([("w", "d1"), ("v", "d1")], "workspace string, id string"),
        "text_chunks": frame([("w", "c1", "d1"), ("w", "c2", "d2")], "workspace string, id string, full_doc_id string"), "nodes": nodes, "edges": edges,
        "llm_response_cache": frame([("w", "x", "c1"), ("w", "y", "c2")], "workspace string, id string, chunk_id string"), "vdb_entities": frame([("A",), ("B",)], "name string"),
    }
    out = maintenance.delete_documents(tables, frame([("w", "d1")], "workspace string, id string"), rec, with_cache=True)
    assert {r["name"]: r["description"] for r in out["nodes"].collect()} == {"A": "a2", "C": "c"}
    assert [(r["src"], r["tgt"], r["weight"], r["description"]) for r in out["edges"].collect()] == [("A", "C", 1.0, "r2")]
    assert [out[k].count() for k in ("full_docs", "doc_status", "text_chunks", "llm_response_cache", "vdb_entities")] == [1, 1, 1, 1, 1]
    assert {r["name"]: r["type"] for r in maintenance.with_endpoints(out["nodes"], edges).collect()} == {"A": "t", "C": "t", "B": "UNKNOWN"}


def test_ingestion_states(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two"), (2, "bad apple"), (3, "one two"), (4, "")], "doc_id long, text string")
    catalog = Catalog(spark, str(tmp_path / "kb"))

    def fragile(text):
        if "bad" in text:
            raise ValueError("rotten")
        return [text[:3], {"content": text[3:], "tokens": 1, "chunk_order_index": 1}]

    ingest.ingest_batch(catalog, docs, ingest.own_chunks(fragile))
    state = {r["status"]: (r["error"], r["chunks_count"]) for r in catalog.read_latest("doc_status", ["id"]).collect()}
    assert state == {"processed": (None, 2), "failed": ("ValueError: rotten", 0)}
    assert {r["status"] for r in catalog.read("doc_status").collect()} == {"pending", "processing", "processed", "failed"}
    assert ingest.process(catalog, ingest.own_chunks(lambda t: "no list")) == 1
    assert "TypeError" in catalog.read_latest("doc_status", ["id"]).filter("status = 'failed'").first()["error"]
    catalog.flag("cancel", True)
    with pytest.raises(ingest.Cancelled):
        ingest.process(catalog)
    catalog.flag("cancel", False)
    assert ingest.process(catalog) == 1 and ingest.process(catalog) == 0
    assert catalog.read("text_chunks").count() == 3 and len(catalog.history()) >= 4
    ingest.enqueue_errors(catalog, spark.createDataFrame([("x.pdf", "no text")], "path string, error string"))
    assert catalog.read_latest("doc_status", ["id"]).filter("id LIKE 'error-%'").first()["status"] == "failed"
    catalog.compact("doc_status", ["id"])
    assert catalog.read("doc_status").count() == 3


def test_catalog_of_two_writers(spark, tmp_path, monkeypatch):
    a, b = (Catalog(spark, str(tmp_path / "kb")) for _ in range(2))
    df = spark.createDataFrame([("1",)], "id string")
    start = a.version()
    a.append({"nodes": df}, start)
    with pytest.raises(Conflict):
        b.append({"nodes": df}, start)
    assert b.read("nodes").count() == 1
    b.append({"nodes": df})
    assert a.read("nodes").count() == 2
    a.drop("nodes")
    assert b.read("nodes") is None
    a.commit({"edges": df})
    a.commit({"edges": df})
    assert a.vacuum(keep=1) == 2 and a.read("edges").count() == 1
    monkeypatch.setattr("lodestack.sources.catalog.MOST_MESSAGES", 5)
    monkeypatch.setattr("lodestack.sources.catalog.KEPT_MESSAGES", 2)
    for i in range(6):
        a.say(str(i))
    assert a.history() == ["4", "5"]


def test_other_stores(spark, tmp_path):
    nodes = spark.createDataFrame([("a", {"k": "v <&>"}), ("b", {})], "label string, data map<string,string>")
    edges = spark.createDataFrame([("a", "b", {"w": "1"})], "src string, tgt string, data map<string,string>")
    stores.write_graphml(nodes, edges, str(tmp_path / "g"))
    n, e = files.read_graphml(spark, str(tmp_path / "g/*"))
    assert {r["label"]: r["data"] for r in n.collect()} == {"a": {"k": "v <&>"}, "b": {}} and e.first()["data"] == {"w": "1"}
    lines = [{"type": "node", "id": "1", "labels": ["x"], "properties": {"entity_id": "A"}}, {"type": "relationship", "id": "9", "label": "R", "properties": {"w": "2"}, "start": {"id": "1", "properties": {"entity_id": "A"}}, "end": {"id": "2", "properties": {"entity_id": "B"}}}]
    (tmp_path / "n.json").write_text("\n".join(map(json.dumps, lines)))
    n, e = stores.read_graph_lines(spark, str(tmp_path / "n.json"))
    assert n.first()["label"] == "A" and (e.first()["src"], e.first()["tgt"]) == ("A", "B")
    rows = spark.createDataFrame([('{"id": 1, "label": "", "properties": {"entity_id": "A"}}::vertex',), ('{"id": 2, "label": "", "properties": {"entity_id": "B"}}::vertex',), ('{"id": 3, "label": "R", "start_id": 1, "end_id": 2, "properties": {"w": 1}}::edge',)], "v string")
    n, e = stores.agtype_graph(rows, "v")
    assert n.count() == 2 and (e.first()["src"], e.first()["tgt"]) == ("A", "B")
    assert one(spark, stores.vector_text("a"), a="[1,2.5]") == [1.0, 2.5]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/rows.json").write_text(json.dumps({"rows": [{"id": "1", "content": "x", "vector": [1, 2]}]}, indent=1))
    assert stores.read_collection(spark, str(tmp_path / "m")).first()["vector"] == [1.0, 2.0]
    vectors = spark.createDataFrame([("a", [1.0, -0.5, 3.25]), ("b", None)], "id string, v array<float>")
    back = vectors.select("id", stores.decoded_vectors(stores.vector_codes("v")).alias("v"))
    assert {r["id"]: r["v"] for r in back.collect()} == {"a": [1.0, -0.5, 3.25], "b": None}
    import base64

    data = {"embedding_dim": 2, "data": [{"__id__": "x", "content": "c"}, {"__id__": "y", "content": "d", "vector": stores.coded_vector([5, 6])}], "matrix": base64.b64encode(np.array([[1, 2]], np.float32).tobytes()).decode()}
    (tmp_path / "vdb.json").write_text(json.dumps(data))
    got = {r["id"]: (r["content"], r["vector"]) for r in stores.read_vector_file(spark, str(tmp_path / "vdb.json"), ["content"]).collect()}
    assert got == {"x": ("c", [1.0, 2.0]), "y": ("d", [5.0, 6.0])}
    stores.write_kv_json(spark.createDataFrame([("i", "v")], "id string, t string"), str(tmp_path / "kv"))
    assert json.loads(spark.read.text(str(tmp_path / "kv")).first()["value"]) == {"i": {"t": "v"}}
    stores.write_json(spark.createDataFrame([("a\x01b",)], "t string"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["t"] == "ab"
    export(nodes, edges, str(tmp_path / "x.xlsx"), "excel")
    with zipfile.ZipFile(tmp_path / "x.xlsx") as z:
        assert z.read("xl/worksheets/sheet2.xml").count(b"<row>") == 3 and b"v &lt;&amp;&gt;" in z.read("xl/worksheets/sheet1.xml")
    assert stores.checked_store("jdbc", "kv", {"JDBC_URL": "x"}) == "jdbc"
    for wrong in (("nothing", "kv"), ("graphml", "kv"), ("jdbc", "kv")):
        with pytest.raises(ValueError):
            stores.checked_store(*wrong, {})


def test_relational_store(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    url = f"jdbc:derby:{tmp_path}/db"
    try:
        jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
        con = jvm.java.sql.DriverManager.getConnection(url + ";create=true")
    except Exception:
        pytest.skip("no embedded database in this session")
    s = con.createStatement()
    s.execute("CREATE TABLE docs (id VARCHAR(20), workspace VARCHAR(20), content VARCHAR(50))")
    for i in range(6):
        s.execute(f"INSERT INTO docs VALUES ('d{i}', 'w{i % 2}', 'text {i}')")
    got = stores.jdbc_table(spark, url, "docs", "w0", ["d0", "d2", "d9"], driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert sorted(r["content"] for r in got.collect()) == ["text 0", "text 2"]
    parts = stores.jdbc_table(spark, url, "docs", workspaces=["w0", "w1"], driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert parts.rdd.getNumPartitions() == 2 and parts.count() == 6


def test_pdfs_by_an_outer_program(spark, tmp_path):
    prog = tmp_path / "parser.py"
    prog.write_text("import sys, json, os, time\np, o = sys.argv[1:]\nif 'slow' in p: time.sleep(30)\nif 'bad' in p: sys.exit('broken file')\nos.makedirs(o + '/x/auto')\n"
                    "json.dump([{'type': 'text', 'text': 'one', 'page_idx': 0}, {'type': 'table', 'table_body': '<t>', 'page_idx': 0}, {'type': 'image', 'img_path': 'i.png', 'page_idx': 1}], open(o + '/x/auto/d_content_list.json', 'w'))\n")
    paths = spark.createDataFrame([("good.pdf",), ("bad.pdf",), ("slow.pdf",)], "path string")
    rows = {r["path"]: r for r in stores.parse_pdfs(paths, f"{sys.executable} {prog} {{path}} {{out}}", timeout=5).collect()}
    assert "broken file" in rows["bad.pdf"]["error"] and "5 seconds" in rows["slow.pdf"]["error"] and rows["good.pdf"]["error"] is None
    pages = stores.pages_of_lists(spark.createDataFrame([("good.pdf", rows["good.pdf"]["content_list"])], "path string, content_list string")).first()["pages"]
    assert [(p["page_number"], p["content"], p["images"]) for p in pages] == [(1, "one\n<t>", []), (2, "", ["i.png"])]
    deep = tmp_path / "root/doc/hybrid_auto"
    deep.mkdir(parents=True)
    (deep / "doc_content_list.json").write_text("[]")
    assert files.cached_parse(spark, str(tmp_path / "root"), "doc").endswith("hybrid_auto/doc_content_list.json")
    assert files.cached_parse(spark, str(tmp_path / "none"), "doc") is None
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for name in ("a.txt", "b.pdf", "bad.pdf", "c.docx"):
        (inbox / name).write_text("text")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(inbox), f"{sys.executable} {prog} {{path}} {{out}}").collect()}
    assert got["a.txt"]["content"] == "text" and got["b.pdf"]["content"] == "one\n<t>\n" and len(got["b.pdf"]["pages"]) == 2
    assert "broken" in got["bad.pdf"]["error"] and ".docx" in got["c.docx"]["error"] and ".pdf" in got["c.docx"]["error"]
    assert "parser" in files.read_documents(spark, str(inbox / "b.pdf")).first()["error"]


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    from lodestack import session

    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: type("C", (), {"get": staticmethod(lambda *a: None)}))})

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Fake)

import glob
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import chunking, keyvalue, references, resolve, search, services
from lodestack.plans import registry
from lodestack.session import env_int, table
from lodestack.sources import files
from lodestack.sources.catalog import Catalog, export
from lodestack.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["p2_found", "bm25_batch", "dense_batch", "rrf_fusion", "merge_nodes", "merge_edges", "parse_entities", "bfs_subgraph", "strategy_mix", "stream_ingest"])
def test_like_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    cur = duck.execute(registry.oracles()[name])
    names = [d[0] for d in cur.description]
    want = sorted(repr(tuple(plain(dict(zip(names, r))[c]) for c in columns)) for r in cur.fetchall())
    assert got == want


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_merge_keys(spark):
    keys = [one(spark, T.merge_key("a"), a=v) for v in ("Water Pumps", "water  pump", "les canaux", "Les canau", "as")]
    assert keys[0] == keys[1] and keys[2] == keys[3] and keys[4] == "as"


def test_names_and_delimiters(spark):
    assert one(spark, T.extracted_name("a"), a=' <p>"ＡＢ  c"</p> ') == "AB  c"
    assert one(spark, T.extracted_name("a"), a="12") == ""
    for bad in ("<|##|>", "<||>", "<#>", "<|#>", "<||#||>", "<| # |>", "<|#|>"):
        assert one(spark, T.repaired_delimiters("a"), a=f"entity{bad}X{bad}y") == "entity<|#|>X<|#|>y", bad
    assert one(spark, T.without_thoughts("a"), a="<think>x</think>y") == "y"
    assert one(spark, T.cleaned_pdf("a"), a="a$^{2}$ ▌b") == "a2 b"


def test_orphans_by_mask(spark):
    refs = spark.createDataFrame([("w", "a", 1), ("w", "z", 1), (None, "a", 1), ("w", None, 1), (None, None, 1), ("w", "a", 1)], "ws string, k string, at int")
    targets = spark.createDataFrame([("w", "a", 0), ("w", "a", 9)], "ws string, k string, since int")

    def kinds(match):
        return sorted((r["ws"] or "-", r["k"] or "-", r["kind"]) for r in references.orphan_references(refs, targets, ["ws", "k"], match).collect())

    assert kinds("simple") == [("w", "z", "missing")]
    assert kinds("partial") == [("w", "z", "missing")]
    assert kinds("full") == [("-", "a", "missing"), ("w", "-", "missing"), ("w", "z", "missing")]
    assert references.orphan_references(refs, targets.limit(0), ["ws", "k"], "simple").count() == 3
    assert references.orphan_references(refs.limit(0), targets, ["ws", "k"]).count() == 0
    with pytest.raises(ValueError):
        references.orphan_references(refs.withColumn("kind", F.lit(1)), targets, ["ws", "k"])


def test_hot_keys(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    from lodestack.operators.skew import hot_hashes, lookup_join

    assert len(hot_hashes(rows, ["k"])) == 1
    lookup = spark.createDataFrame([("hot", 1), ("1", 2)], "k string, v int")
    got = lookup_join(rows, lookup, ["k"])
    assert got.count() == 9000 and got.agg(F.sum("v")).first()[0] == 3000 + 2


def test_limits_and_lists(spark):
    df = spark.createDataFrame([(["a", "b", "c", "b"], ["b"], ["d"])], "a array<string>, b array<string>, c array<string>")
    r = df.select(
        resolve.limited(F.col("a"), 2).alias("fifo"), resolve.limited(F.col("a"), 2, "KEEP").alias("keep"), resolve.limited(F.col("a"), 0).alias("none"),
        resolve.subtracted_ids(F.col("a"), F.col("b")).alias("sub"), resolve.incremental_ids(F.col("a"), F.col("b"), F.col("c")).alias("inc"),
        resolve.merged_ids(F.col("c"), F.col("a")).alias("merged"), resolve.capped_paths(F.col("a"), 1).alias("capped"),
    ).first()
    assert r["fifo"] == ["c", "b"] and r["keep"] == ["a", "b"] and r["none"] == [] and r["sub"] == ["a", "c"]
    assert r["inc"] == ["a", "c", "d"] and r["merged"] == ["d", "a", "b", "c"] and r["capped"] == ["b", "...truncated...(FIFO)"]


def test_budget_and_pages(spark):
    df = spark.createDataFrame([(1, i, "x" * 40) for i in range(5)], "q int, o int, t string")
    assert search.within_budget(df, ["q"], ["o"], "t", 30).count() == 3
    assert search.within_budget(df, ["q"], ["o"], "t", 0).count() == 0
    many = spark.range(300).withColumnRenamed("id", "n")
    assert keyvalue.page(many, "n", 1, 1, ["n"], ["n"]).count() == 10 and keyvalue.page(many, "bad", 1, 999, ["n"], ["n"]).count() == 200
    with pytest.raises(ValueError):
        chunking.checked(10, 10)
    assert env_int("x", 5) == 5 and env_int("12", 5) == 12 and env_int("0", 5) == 5 and env_int(None, 5) == 5


def test_services(spark):
    df = spark.createDataFrame([("1", "a b"), ("2", "a b"), ("3", "c")], "id string, prompt string")
    vectors = services.embed_column(df, "prompt", services.hash_embed(8), 8).collect()
    assert len(vectors[0]["vector"]) == 8 and vectors[0]["vector"] == vectors[1]["vector"]
    cache = spark.createDataFrame([], "id string, return_value string")
    answers, new = services.cached_calls(df, cache, lambda p: [x.upper() for x in p], "default", "query")
    assert {r["id"]: r["return_value"] for r in answers.collect()} == {"1": "A B", "2": "A B", "3": "C"} and new.count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hällo")
    assert files.read_text(spark, str(tmp_path / "a.txt")).first()["pages"][0]["page_number"] == 1
    (tmp_path / "b.docx").write_text("x")
    with pytest.raises(Exception, match="docx"):
        files.read_text(spark, str(tmp_path / "b.docx")).collect()
    items = [{"type": "text", "text": "one", "page_idx": 0}, {"type": "table", "table_body": "<t>", "page_idx": 0}, {"type": "image", "img_path": "i.png", "page_idx": 1}]
    (tmp_path / "auto").mkdir()
    (tmp_path / "auto" / "d_content_list.json").write_text(json.dumps(items))
    pages = files.read_content_list(spark, files.cached_parse(spark, str(tmp_path), "d")).first()["pages"]
    assert [(p["page_number"], p["content"], p["images"]) for p in pages] == [(1, "one\n<t>", []), (2, "", ["i.png"])]
    assert files.cached_parse(spark, str(tmp_path), "nothing") is None


def test_catalog_and_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, ""), (4, None), (5, "three")], "doc_id long, text string")
    catalog = Catalog(spark, str(tmp_path / "kb"))
    for _ in range(2):
        ingest.ingest_batch(catalog, docs)
    assert catalog.read("text_chunks").count() == 2
    assert catalog.read_latest("doc_status", ["id"]).count() == 2
    catalog.commit({"text_chunks": None})
    assert catalog.read("text_chunks") is None
    edges = spark.createDataFrame([("a", "b")], "src string, tgt string")
    export(spark.createDataFrame([("a",)], "label string"), edges, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/relations")).count() == 2


def test_entry_without_llm():
    import __spark_entry__ as e

    assert {"p2_found", "bm25_topk"} <= e.queries().keys() and e.oracle_sql().keys() <= e.queries().keys()


def test_smoke(spark):
    assert table(spark, SF, "documents").count() > 0


@pytest.mark.parametrize("threshold", ["6k", "8k", "10k"])
def test_cache_lists_where_adaptive_execution_broadcasts(spark, duck, threshold):
    """At 8k the calls are broadcast only when their size is known, as on larger tables by the default."""
    key, df = "spark.sql.autoBroadcastJoinThreshold", registry.queries()["cache_lists"]
    old = spark.conf.get(key)
    spark.conf.set(key, threshold)
    try:
        got = sorted(map(repr, map(tuple, df(spark, SF).collect())))
    finally:
        spark.conf.set(key, old)
    assert got == sorted(map(repr, duck.execute(registry.oracles()["cache_lists"]).fetchall()))


def test_cache_lists_of_nulls(spark, tmp_path):
    at = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
    cache = [("w", "a", "c", None), ("w", "b", "c", "2024-01-01"), ("w", "b", None, "2024-01-01"), ("w", "d", None, None), ("v", "a", "gone", "2024-01-01")]
    spark.createDataFrame(cache, "workspace string, id string, chunk_id string, t string").selectExpr(
        "workspace", "id", "chunk_id", "'extract' cache_type", "CAST(t AS TIMESTAMP_NTZ) create_time"
    ).write.parquet(f"{tmp_path}/ekr_llm_cache.parquet")
    chunks = [("w", "c", ["a", "d", "x", None, "a"]), ("w", None, ["b"]), ("v", "e", None), ("v", "f", ["a"]), (None, "c", ["a"])]
    spark.createDataFrame(chunks, "workspace string, id string, llm_cache_list array<string>").selectExpr(
        "*", "'d' full_doc_id", "1 chunk_order_index", f"{at} update_time"
    ).write.parquet(f"{tmp_path}/ekr_doc_chunks.parquet")
    con = duckdb.connect()
    for name in ("ekr_llm_cache", "ekr_doc_chunks"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(registry.oracles()["cache_lists"]).fetchall()
    got = map(tuple, registry.queries()["cache_lists"](spark, str(tmp_path)).collect())
    assert len(want) == 5 and sorted(map(repr, got)) == sorted(map(repr, want))

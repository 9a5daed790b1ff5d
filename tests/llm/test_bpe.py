import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import bpe
from lodestack.session import table

RANKS = bpe.read_ranks(bpe.vocabulary_path())
PAIRS = bpe.PairTable(RANKS)
OTHER = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def encode(texts):
    return list(bpe.Encoder(PAIRS).encode(texts))


def test_cases():
    texts = [None, "", " ", "  \n\t x", "<|endoftext|>", "a" * 3000, "ab" * 700 + "é" * 400, "日本語 テスト", "don't we'LL", "​­¬",
             "x" * 255, "x" * 256, "x" * 257, "-" * 1000 + "1" * 999]
    for text, ids in zip(texts, encode(texts)):
        assert ids == (OTHER.encode_ordinary(text) if text else [])
        assert bpe.decode_ids(ids, RANKS) == (text or "")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=200), min_size=1, max_size=5))
def test_like_the_public_encoder(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert encode(texts) == [OTHER.encode_ordinary(t) for t in texts]


def test_whole_table(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    got = bpe.p6_ids(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["ids"] == (OTHER.encode_ordinary(docs[r["doc_id"]]) if docs[r["doc_id"]] else [])


def test_frames(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "n int, text string")
    assert sorted((r["n"], r["ids"]) for r in bpe.encode_column(df, "text").collect()) == [(1, [64, 275]), (1, [64, 275]), (2, [])]
    assert bpe.encode_column(df.limit(0), "text").count() == 0
    assert bpe.encode_column(df, "text", "n_tokens", count_only=True).agg({"n_tokens": "sum"}).first()[0] == 4


def test_totals_like_ids(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    want = docs.join(bpe.p6_ids(spark, sf), "doc_id").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("ids")).alias("n_tokens"))
    assert sorted(map(repr, bpe.p6_token_totals(spark, sf).collect())) == sorted(map(repr, want.collect()))

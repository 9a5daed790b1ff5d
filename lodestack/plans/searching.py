"""Queries of sparse and dense search, fusion, budgets and reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.operators import search as s
from lodestack.plans import tables as t
from lodestack.plans.book import Book
from lodestack.session import table

book = Book()

BM25_SQL = """tokens AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents),
avgdl AS (SELECT avg(coalesce(len(t), 0)::DOUBLE) AS avgdl FROM tokens),
postings AS (SELECT doc_id, term, count(*)::DOUBLE AS tf, max(dl)::DOUBLE AS dl FROM (SELECT doc_id, unnest(t) AS term, len(t) AS dl FROM tokens) GROUP BY 1, 2),
n AS (SELECT count(*)::DOUBLE AS n FROM documents),
raw AS (SELECT term, count(*)::DOUBLE AS df, ln(n - count(*)::DOUBLE + 0.5e0) - ln(count(*)::DOUBLE + 0.5e0) AS raw FROM postings, n GROUP BY term, n),
stats AS (SELECT term, df, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25e0 FROM raw) ELSE raw END AS idf FROM raw),
scores AS (SELECT query_id, doc_id, sum(idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score
  FROM query_terms JOIN stats USING (term) JOIN postings USING (term), avgdl GROUP BY 1, 2 HAVING score > 0),
sparse AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores) WHERE rank <= 20)"""
DENSE_SQL = """dense AS (SELECT * FROM (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], query::DOUBLE[]) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], query::DOUBLE[]), 12) DESC, vec_id) AS rank
  FROM embeddings, query_vectors) WHERE rank <= 20)"""


def sparse(spark, sf, k=20):
    return s.bm25(table(spark, sf, "documents").select("doc_id", "text"), t.query_terms(spark), "doc_id", "text", k)


def dense(spark, sf, k=20):
    return s.dense(table(spark, sf, "embeddings"), t.query_vectors(spark, sf), "vec_id", "embedding", k)


@book.query("bm25_topk", t.cte("query_terms", extra=BM25_SQL) + "SELECT doc_id, round(score, 6) AS score, rank FROM sparse WHERE query_id = 0")
def bm25_topk(spark, sf):
    terms = t.query_terms(spark).filter("query_id = 0")
    hits = s.bm25(table(spark, sf, "documents").select("doc_id", "text"), terms, "doc_id", "text", 20)
    return hits.select("doc_id", F.round("score", 6).alias("score"), "rank")


@book.query("bm25_batch", t.cte("query_terms", extra=BM25_SQL) + "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM sparse")
def bm25_batch(spark, sf):
    return sparse(spark, sf).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@book.query("corpus_stats", t.cte("query_terms", extra=BM25_SQL) + "SELECT term, df, round(idf, 6) AS idf FROM stats")
def corpus_stats(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return s.term_stats(docs, "text").select("term", "df", F.round("idf", 6).alias("idf"))


@book.query("dense_topk", t.cte("query_vectors", extra=DENSE_SQL) + "SELECT vec_id, round(score, 6) AS score, rank FROM dense WHERE query_id = 20")
def dense_topk(spark, sf):
    one = t.query_vectors(spark, sf).filter("query_id = 20")
    return s.dense(table(spark, sf, "embeddings"), one, "vec_id", "embedding", 20).select("vec_id", F.round("score", 6).alias("score"), "rank")


@book.query("dense_batch", t.cte("query_vectors", extra=DENSE_SQL) + "SELECT query_id, vec_id, round(score, 6) AS score, rank FROM dense")
def dense_batch(spark, sf):
    return dense(spark, sf).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@book.query("dense_threshold", t.cte("query_vectors", extra=DENSE_SQL) + "SELECT query_id, vec_id, round(score, 6) AS score, rank FROM dense WHERE score >= 0.2e0")
def dense_threshold(spark, sf):
    hits = s.dense(table(spark, sf, "embeddings"), t.query_vectors(spark, sf), "vec_id", "embedding", 20, 0.2)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


FUSED_SQL = BM25_SQL + ",\n" + DENSE_SQL + """,
lists AS (SELECT query_id, doc_id AS key, rank FROM sparse UNION ALL SELECT query_id, vec_id, rank FROM dense),
fused AS (SELECT query_id, key, sum(1e0 / (60e0 + rank)) AS score, min(rank) AS best FROM lists GROUP BY 1, 2)"""


@book.query("rrf_fusion", t.cte("query_terms", "query_vectors", extra=FUSED_SQL) + """
SELECT query_id, key, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, best, key) AS rank FROM fused) WHERE rank <= 20""")
def rrf_fusion(spark, sf):
    lists = [dense(spark, sf).withColumnRenamed("vec_id", "key"), sparse(spark, sf).withColumnRenamed("doc_id", "key")]
    return s.rrf(lists, "key", 20).select("query_id", "key", F.round("score", 6).alias("score"), "rank")


@book.query("round_robin_merge", t.cte("query_terms", "query_vectors", extra=BM25_SQL + ",\n" + DENSE_SQL + """,
lists AS (SELECT query_id, doc_id AS key, rank, 1 AS source FROM sparse UNION ALL SELECT query_id, vec_id, rank, 0 FROM dense),
first AS (SELECT query_id, key, rank, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY rank, source) AS rn FROM lists) WHERE rn = 1)""") + """
SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY rank, source) AS position FROM first""")
def round_robin_merge(spark, sf):
    return s.round_robin([dense(spark, sf).withColumnRenamed("vec_id", "key"), sparse(spark, sf).withColumnRenamed("doc_id", "key")], "key")


@book.query("budget_prefix", t.cte("query_terms", extra=BM25_SQL) + """
SELECT query_id, doc_id, used FROM (SELECT query_id, doc_id, sum(length(text)::DOUBLE / 4) OVER (PARTITION BY query_id ORDER BY rank) AS used
FROM sparse JOIN documents USING (doc_id)) WHERE used <= 900""")
def budget_prefix(spark, sf):
    hits = sparse(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return s.within_budget(hits, ["query_id"], ["rank"], "text", 900).select("query_id", "doc_id", "used")


@book.query("reference_list", t.cte("query_terms", extra=BM25_SQL) + """
SELECT query_id, file_path, n_chunks, row_number() OVER (PARTITION BY query_id ORDER BY n_chunks DESC, first) AS reference_id FROM
(SELECT query_id, file_path, count(*) AS n_chunks, min(rank) AS first FROM sparse JOIN documents USING (doc_id) WHERE file_path <> '' GROUP BY 1, 2)""")
def reference_list(spark, sf):
    hits = sparse(spark, sf).join(table(spark, sf, "documents").select("doc_id", "file_path"), "doc_id")
    return s.references(hits, "file_path", "rank")


RERANK_SQL = BM25_SQL + """,
asked AS (SELECT query_id, list(DISTINCT term) AS q FROM query_terms GROUP BY 1),
scored AS (SELECT query_id, doc_id, rank AS before, len(list_intersect(q, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))))::DOUBLE / len(q) AS score
  FROM sparse JOIN documents USING (doc_id) JOIN asked USING (query_id))"""


def asked_words(spark):
    return t.query_terms(spark).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("question"))


@book.query("rerank_topn", t.cte("query_terms", extra=RERANK_SQL) + """
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM scored) WHERE rank <= 5""")
def rerank_topn(spark, sf):
    """The best five of twenty by the stand-in reranker."""
    hits = sparse(spark, sf).drop("score").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").join(F.broadcast(asked_words(spark)), "query_id")
    best = s.reranked(hits, s.overlap_score("question", "text"), 5)
    return best.select("query_id", "doc_id", F.round("rerank_score", 6).alias("score"), "rank")


@book.query("rerank_chunk_agg", t.cte("chunks", extra="""
q(question) AS (VALUES (['the', 'station', 'harbour', 'values'])),
scored AS (SELECT workspace, full_doc_id, chunk_order_index AS o, id, len(list_intersect(question, list_distinct(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+'))))::DOUBLE / 4 AS score
  FROM chunks, q WHERE full_doc_id IS NOT NULL AND content IS NOT NULL)""") + """
SELECT workspace, full_doc_id, max(score) AS max_score, round(avg(score), 6) AS mean_score, arg_min(score, (o, id)) AS first_score FROM scored GROUP BY 1, 2""")
def rerank_chunk_agg(spark, sf):
    """Scores of documents from those of their chunks."""
    rows = t.chunks(spark, sf).filter("full_doc_id IS NOT NULL AND content IS NOT NULL").withColumn("question", F.lit("the station harbour values"))
    rows = rows.withColumn("score", s.overlap_score("question", "content")).withColumn("o", F.struct("chunk_order_index", "id"))
    return s.aggregate_scores(rows, ["workspace", "full_doc_id"], "score", "o").withColumn("mean_score", F.round("mean_score", 6))

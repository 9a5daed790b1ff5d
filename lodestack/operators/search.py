"""Sparse and dense search, fusion and budgets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.functions.text import estimated_tokens, words
from lodestack.session import Shared, cut, cut_all, reachable

K1, B, RRF = 1.5, 0.75, 60
MOST_QUERIES = 10_000
BLOCK_CELLS = 1 << 22


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf and length of the document for every term of every document: the table of an index."""
    toks = docs.select(key, F.explode(F.array(words(text))).alias("t")).filter(F.size("t") > 0)
    return (
        toks.select(key, F.size("t").cast("double").alias("dl"), F.explode("t").alias("term"))
        .groupBy(key, "term").agg(F.count(F.lit(1)).cast("double").alias("tf"), F.max("dl").alias("dl"))
    )


def corpus(docs: DataFrame, text: str) -> DataFrame:
    """One row: the number of documents and their mean number of words, empty ones included."""
    n = F.coalesce(F.size(words(text)), F.lit(0)).cast("double")
    return docs.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(n).alias("avgdl"))


def document_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """term and df. A document's terms are made distinct within its row, so that only counts are shuffled."""
    return docs.select(F.explode(F.array_distinct(words(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))


def _idf(df: str = "df") -> Column:
    return F.log(F.col("n") - F.col(df) + 0.5) - F.log(F.col(df) + 0.5)


def term_stats(docs: DataFrame, text: str) -> DataFrame:
    """term, df and idf. Negative idf become a quarter of the mean idf of all terms."""
    raw = document_frequencies(docs, text).crossJoin(F.broadcast(corpus(docs, text).select("n"))).withColumn("raw", _idf())
    mean = F.broadcast(raw.agg((F.avg("raw") * 0.25).alias("floor")))
    return raw.crossJoin(mean).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


MOST_ASKED = 100_000


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, key, score and rank of the k best documents a query.

    queries are (query_id, term), a repeated term counting repeatedly, at most MOST_ASKED
    terms in a batch, which bounds what is broadcast. Words that nobody asks for are dropped
    where they are read, before anything is shuffled; the frequencies of all other terms are
    counted only if an asked one is in more than half of the documents, as the floor of its
    weight is made of all. Scores of 0 or less are dropped; ties go by key.
    """
    asked = cut(queries.groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("times")))
    if asked.count() > MOST_ASKED:
        raise ValueError(f"more than {MOST_ASKED} asked terms; search them in batches")
    terms = asked.select("term").distinct()
    # One element exploded keeps the words from being split anew for each use of them.
    rows = docs.select(key, F.explode(F.array(words(text))).alias("t")).filter(F.size("t") > 0)
    met = (
        rows.select(key, F.size("t").cast("double").alias("dl"), F.explode("t").alias("term")).join(F.broadcast(terms), "term")
        .groupBy(key, "term").agg(F.count(F.lit(1)).cast("double").alias("tf"), F.max("dl").alias("dl"))
    )
    met, whole = cut_all(met, corpus(docs, text))
    stats = cut(met.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df")).crossJoin(whole).withColumn("raw", _idf()))
    if stats.filter("raw < 0").isEmpty():
        floor = F.lit(0.0)
    else:
        all_terms = document_frequencies(docs, text).crossJoin(F.broadcast(whole.select("n")))
        floor = F.lit(all_terms.agg(F.avg(_idf()) * 0.25).first()[0])
    weighed = asked.join(stats.withColumn("idf", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw"))), "term")
    tf = F.col("tf")
    weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scores = (
        met.join(F.broadcast(weighed), "term").groupBy("query_id", key)
        .agg(F.sum(F.col("times") * F.col("idf") * weight).alias("score")).filter("score > 0")
    )
    return top(scores, ["query_id"], [F.round("score", 9).desc(), F.col(key)], k)


def top(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows of each group with their rank; limited before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*groups).orderBy(*order)).cast("bigint")
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def numbered(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """All rows numbered from 1 in an order, without bringing them into one task.

    Rows are sorted in ranges, ranges counted, and each row gets its place within its range
    and the number of rows before it. The order must be total.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    # One row a partition, so this window is small.
    before = sizes.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(W.partitionBy("__p").orderBy(*order))
    return ranged.withColumn("__i", place).join(F.broadcast(before), "__p").withColumn(out, (F.col("__i") + F.col("__before")).cast("bigint")).drop("__p", "__i", "__before")


def query_matrices(queries: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of at most MOST_QUERIES queries (query_id, query), by the length of the vectors; zero and null ones are left out."""
    got = queries.select(F.col("query_id").cast("bigint"), F.col("query").cast("array<double>")).limit(MOST_QUERIES + 1).collect()
    if len(got) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries; search them in batches")
    groups: dict[int, list] = {}
    for q, v in got:
        if v and None not in v and any(v):
            groups.setdefault(len(v), []).append((q, v))
    out = {}
    for dim, rows in groups.items():
        x = np.array([v for _, v in rows])
        out[dim] = (np.array([q for q, _ in rows]), x / np.linalg.norm(x, axis=1, keepdims=True))
    return out


def dense(vectors: DataFrame, queries: DataFrame, key: str | Sequence[str], vector: str, k: int, threshold: float | None = None) -> DataFrame:
    """query_id, key, score and rank of the k most similar vectors by cosine, those below the threshold dropped.

    queries (query_id, query) are one batch of at most MOST_QUERIES, which bounds what is
    broadcast. Every batch of vectors gives its own k best a query by matrix products, so
    that k rows a query and batch are shuffled. Ties at twelve digits go by key; vectors that
    are null, zero, of another length or with null elements are met by no query.
    """
    keys = [key] if isinstance(key, str) else list(key)
    spark = vectors.sparkSession
    shared = Shared(spark, query_matrices(queries))
    kinds = dict(vectors.dtypes)
    sort_keys = [("score", "descending"), *((c, "ascending") for c in keys)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            for dim, (ids, x) in shared.value.items():
                rows = np.flatnonzero(lengths == dim)
                for lo in range(0, len(rows), max(1, BLOCK_CELLS // max(len(ids), dim))):
                    at = rows[lo : lo + max(1, BLOCK_CELLS // max(len(ids), dim))]
                    y = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                    size = np.linalg.norm(y, axis=1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        scores = np.round((x @ y.T) / size, 12)
                    scores[:, ~(np.isfinite(size) & (size > 0))] = -np.inf
                    m = min(k, len(at))
                    least = -np.partition(-scores, m - 1, axis=1)[:, m - 1 : m]
                    q, row = np.nonzero((scores >= least) & np.isfinite(scores))
                    found = pa.Table.from_arrays(
                        [pa.array(ids[q]), *(batch.column(i).take(pa.array(at[row])) for i in range(len(keys))), pa.array(scores[q, row])], names=["query_id", *keys, "score"]
                    )
                    if len(found) > m * len(ids):
                        # Many equal scores: only the first m keys of each query are needed.
                        found = found.take(pc.sort_indices(found, [("query_id", "ascending"), *sort_keys]))
                        qs = found.column("query_id").to_numpy()
                        first = np.searchsorted(qs, qs)
                        found = found.filter(pa.array(np.arange(len(qs)) - first < m))
                    yield from found.to_batches()

    reachable(spark)
    schema = ", ".join(["query_id bigint", *(f"`{c}` {kinds[c]}" for c in keys), "score double"])
    scored = vectors.select(*keys, F.col(vector).cast("array<double>").alias("__v")).mapInArrow(run, schema)
    best = top(scored, ["query_id"], [F.col("score").desc(), *(F.col(c) for c in keys)], k)
    return best if threshold is None else best.filter(F.col("score") >= threshold)


def rrf(rankings: Sequence[DataFrame], key: str, k: int, constant: int = RRF) -> DataFrame:
    """Fused ranking of (query_id, key, rank) lists: the sum of 1 / (constant + rank); ties go by best rank, then key."""
    union = rankings[0].select("query_id", key, "rank")
    for r in rankings[1:]:
        union = union.unionByName(r.select("query_id", key, "rank"))
    fused = union.groupBy("query_id", key).agg(
        F.sum(F.lit(1.0) / (F.lit(float(constant)) + F.col("rank"))).alias("score"), F.min("rank").alias("best")
    )
    return top(fused, ["query_id"], [F.round("score", 12).desc(), F.col("best"), F.col(key)], k).drop("best")


def round_robin(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """query_id, key and position of lists merged in turn; the first appearance of a key counts, null keys are dropped."""
    parts = [s.select("query_id", key, "rank", F.lit(i).alias("source")) for i, s in enumerate(sources)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    first = union.filter(F.col(key).isNotNull()).groupBy("query_id", key).agg(F.min(F.struct("rank", "source")).alias("at"))
    position = F.row_number().over(W.partitionBy("query_id").orderBy("at.rank", "at.source")).cast("bigint")
    return first.select("query_id", key, position.alias("position"))


def within_budget(df: DataFrame, groups: Sequence[str], order: Sequence[str], text: str, budget: float | Column) -> DataFrame:
    """The rows up to the first whose running sum of estimated tokens exceeds the budget, with that sum; none for a budget of 0 or less."""
    w = W.partitionBy(*groups).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    used = df.withColumn("used", F.sum(F.coalesce(estimated_tokens(text), F.lit(0.0))).over(w))
    most = budget if isinstance(budget, Column) else F.lit(float(budget))
    return used.filter((F.col("used") <= most) & (most > 0))


def references(df: DataFrame, path: str, order: str, groups: Sequence[str] = ("query_id",)) -> DataFrame:
    """Files of the chunks, numbered from 1 by how many chunks they have, then by first appearance."""
    counted = df.filter(F.col(path).isNotNull() & (F.col(path) != "")).groupBy(*groups, path).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.min(order).alias("first")
    )
    number = F.row_number().over(W.partitionBy(*groups).orderBy(F.desc("n_chunks"), "first")).cast("bigint")
    return counted.select(*groups, path, "n_chunks", number.alias("reference_id"))


def overlap_score(query: str, content: str) -> Column:
    """The stand-in reranker: share of the query's distinct words that the content has."""
    q, c = F.array_distinct(words(query)), F.array_distinct(words(content))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, c)).cast("double"), F.size(q).cast("double")), F.lit(0.0))


def reranked(df: DataFrame, score: Column, k: int, groups: Sequence[str] = ("query_id",)) -> DataFrame:
    """The k best rows by score, with their former rank as `before`; unscored ones keep their order at the tail."""
    rows = df.withColumnRenamed("rank", "before").withColumn("rerank_score", score)
    return top(rows, list(groups), [F.col("rerank_score").desc_nulls_last(), F.col("before")], k)


def aggregate_scores(df: DataFrame, groups: Sequence[str], score: str, order: str) -> DataFrame:
    """Scores of a document's parts as maximum, mean and first."""
    return df.groupBy(*groups).agg(
        F.max(score).alias("max_score"), F.avg(score).alias("mean_score"), F.min_by(score, order).alias("first_score")
    )

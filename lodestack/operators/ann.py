"""Approximate nearest neighbours: vectors in lists around centres, of which a query searches a few."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.vectors import cosine
from lodestack.operators.search import query_matrices, top
from lodestack.session import Shared, reachable

SAMPLE = 20_000


class Lists:
    """Centres of a bounded sample by k-means on the sphere."""

    def __init__(self, sample: np.ndarray, many: int, rounds: int = 12, seed: int = 0):
        rng = np.random.default_rng(seed)
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.centres = x[rng.choice(len(x), min(many, len(x)), replace=False)].copy()
        for _ in range(rounds):
            own = (x @ self.centres.T).argmax(1)
            for c in range(len(self.centres)):
                if (own == c).any():
                    mean = x[own == c].mean(0)
                    self.centres[c] = mean / max(1e-12, np.linalg.norm(mean))

    def nearest(self, x: np.ndarray, probes: int = 1) -> np.ndarray:
        return np.argsort(-(x @ self.centres.T), axis=1, kind="stable")[:, :probes]


def fitted(vectors: DataFrame, vector: str, many: int | None = None, sample: int = SAMPLE, seed: int = 0) -> Lists:
    """Lists fitted on at most `sample` vectors; as many as the square root of the table unless given."""
    n = vectors.count()
    usual = vectors.filter(F.size(vector) > 0).agg(F.mode(F.size(vector)).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    if not usual["n"]:
        raise ValueError("there is no vector to fit on")
    rows = vectors.filter(F.size(vector) == usual["dim"]).select(F.col(vector).cast("array<double>").alias("v")).filter(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull()))
    rows = rows.orderBy(F.xxhash64(F.lit(seed), "v")).limit(sample).toPandas()
    if not len(rows):
        raise ValueError("there is no vector to fit on")
    return Lists(np.stack(rows["v"].to_numpy()), many or max(1, int(np.sqrt(n))), seed=seed)


def indexed(vectors: DataFrame, vector: str, lists: Lists) -> DataFrame:
    """vectors with the list each is in; every row is kept, null, zero and strange vectors in list -1. Written partitioned by list, a search reads few files."""
    shared = Shared(vectors.sparkSession, lists)
    dim = lists.centres.shape[1]
    reachable(vectors.sparkSession)
    kinds = ", ".join(f"`{c}` {k}" for c, k in vectors.dtypes)

    def run(batches):
        for rows in batches:
            own = np.full(len(rows), -1)
            good = [i for i, v in enumerate(rows[vector]) if v is not None and len(v) == dim]
            if good:
                x = np.stack(rows[vector].iloc[good].to_numpy()).astype(np.float64)
                fit = np.isfinite(x).all(1) & (x != 0).any(1)
                own[np.array(good)[fit]] = shared.value.nearest(x[fit])[:, 0]
            yield rows.assign(list=own.astype(np.int32))

    return vectors.mapInPandas(run, f"{kinds}, list int")


def search(index: DataFrame, lists: Lists, queries: DataFrame, key: str, vector: str, k: int, probes: int) -> DataFrame:
    """query_id, key, score and rank of the k best of the `probes` lists nearest to each query (query_id, query)."""
    spark = index.sparkSession
    rows = [(int(q), int(c), v.tolist()) for ids, x in query_matrices(queries).values() if x.shape[1] == lists.centres.shape[1] for q, v, cs in zip(ids, x, lists.nearest(x, probes)) for c in cs]
    asked = spark.createDataFrame(rows, "query_id bigint, list int, query array<double>")
    met = index.join(F.broadcast(asked), "list").withColumn("score", F.round(cosine(F.col(vector), F.col("query")), 12))
    return top(met.filter("score IS NOT NULL").select("query_id", key, "score"), ["query_id"], [F.col("score").desc(), F.col(key)], k)

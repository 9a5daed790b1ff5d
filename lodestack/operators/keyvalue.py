"""Keyed tables: upsert, delete, ordered lookup, missing keys, status counts and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATUSES = ("pending", "processing", "preprocessed", "processed", "failed")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the first by order. The window keeps only first rows before it shuffles."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with the rows of new put in place of those with equal keys. new is unique by key."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*old.columns))


def overlay(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old and new by key, each column from new where it isn't null there."""
    rest = [c for c in old.columns if c not in keys]
    joined = old.alias("o").join(new.alias("n"), list(keys), "full_outer")
    return joined.select(*keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in rest])


def delete_keys(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def by_ids(df: DataFrame, wanted: DataFrame, key: str, position: str = "pos") -> DataFrame:
    """A row for each wanted key in its position; columns are null where the key is missing."""
    return wanted.select(position, key).join(df, key, "left")


def missing_keys(wanted: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(df.select(key), key, "left_anti")


def status_counts(df: DataFrame, column: str = "status") -> DataFrame:
    """Rows of each known status, also of those without any."""
    known = df.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = df.groupBy(F.col(column).alias("status")).agg(F.count(F.lit(1)).alias("n_docs"))
    return known.join(counts, "status", "left").fillna(0, ["n_docs"])


def status_rollup(df: DataFrame, column: str = "status") -> DataFrame:
    """Rows of each status found and of `all`."""
    rows = df.select(F.col(column).alias("status"))
    return (
        rows.rollup("status").agg(F.grouping("status").alias("g"), F.count(F.lit(1)).alias("n_docs"))
        .select(F.when(F.col("g") == 1, "all").otherwise(F.col("status")).alias("status"), "n_docs")
    )


def page(df: DataFrame, sort: str, number: int, size: int, allowed: Sequence[str], tie: Sequence[str] = ("id",), descending: bool = True) -> DataFrame:
    """One page of a table: size held between 10 and 200, an unknown sort column replaced by the first allowed."""
    size, number = max(10, min(200, size)), max(1, number)
    by = F.col(sort if sort in allowed else allowed[0])
    return df.orderBy(by.desc() if descending else by.asc(), *tie).offset((number - 1) * size).limit(size)


def consistent(status: DataFrame, full: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status rows after a crash: those without a document go unless failed; running and failed ones wait again."""
    there = status.join(full.select(*keys).distinct().withColumn("__there", F.lit(True)), list(keys), "left")
    kept = there.filter(F.col("__there") | (F.col("status") == "failed")).drop("__there")
    again = F.col("status").isin("processing", "failed")
    return kept.withColumn("status", F.when(again, "pending").otherwise(F.col("status")))


def enqueue(incoming: DataFrame, known: DataFrame, content: str, order: str) -> DataFrame:
    """New documents: the first of equal contents, without those known by id."""
    from lodestack.functions.text import content_id, sanitize

    rows = incoming.withColumn("content", sanitize(content)).filter("content <> ''")
    first = latest(rows, ["content"], [F.col(order).asc()])
    return first.withColumn("id", content_id("doc", "content")).join(known.select("id").distinct(), "id", "left_anti")

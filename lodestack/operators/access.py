"""Point access and projections: lookups, presence, defaults, typed rows, status rules, stored vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions.text import SEP


def by_id(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row of a key: a filter that reaches the files."""
    return df.filter(F.col(key) == F.lit(value))


def found_by_ids(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of the wanted keys, once each; missing keys give nothing."""
    return df.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def is_empty(df: DataFrame) -> DataFrame:
    """One row: whether the table has none."""
    return df.limit(1).agg((F.count(F.lit(1)) == 0).alias("is_empty"))


def has_nodes(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """label and whether there is such a node."""
    return asked.select("label").distinct().join(nodes.select("label").distinct().withColumn("there", F.lit(True)), "label", "left").fillna(False, ["there"])


def meta_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The id and those of the declared fields that the table has."""
    return df.select("id", *[c for c in fields if c in df.columns and c != "id"])


def user_entities(df: DataFrame) -> DataFrame:
    """Entities with defaults where a value is missing: type UNKNOWN, path unknown_source."""
    return df.select(
        "label", _or("type", "UNKNOWN"), _or("description", ""), _or("source_id", ""), _or("file_path", "unknown_source"),
    )


def user_relations(df: DataFrame) -> DataFrame:
    return df.select(
        "src", "tgt", _or("description", ""), _or("keywords", ""), F.coalesce("weight", F.lit(1.0)).alias("weight"), _or("source_id", ""), _or("file_path", "unknown_source")
    )


def user_chunks(df: DataFrame) -> DataFrame:
    return df.select(_or("reference_id", ""), _or("content", ""), _or("file_path", "unknown_source"), "chunk_id")


def _or(column: str, default: str) -> Column:
    return F.coalesce(F.col(column), F.lit(default)).alias(column)


def entity_info(nodes: DataFrame, vectors: DataFrame | None, asked: DataFrame) -> DataFrame:
    """The nodes of the asked labels, with their stored vector rows where those are wanted."""
    rows = asked.select("label").distinct().join(nodes, "label")
    return rows if vectors is None else rows.join(vectors, "label", "left")


def relation_info(edges: DataFrame, vectors: DataFrame | None, asked: DataFrame) -> DataFrame:
    pair = asked.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).distinct()
    rows = pair.join(edges, ["src", "tgt"])
    return rows if vectors is None else rows.join(vectors, ["src", "tgt"], "left")


def typed_lists(df: DataFrame, raw: str, schemas: dict[str, T.StructType]) -> DataFrame:
    """A column of JSON objects as typed lists: known fields of the named lists, all others dropped."""
    whole = T.StructType([T.StructField("data", T.StructType([T.StructField(name, T.ArrayType(s)) for name, s in schemas.items()]))])
    read = F.from_json(F.col(raw), whole)["data"]
    keep = [c for c in df.columns if c != raw]
    return df.select(*keep, *[F.coalesce(read[name], F.array().cast(T.ArrayType(s))).alias(name) for name, s in schemas.items()])


def shown_status(status: Column, metadata: Column) -> Column:
    """processed becomes preprocessed while the metadata says that images are not."""
    return F.when((status == "processed") & (F.get_json_object(metadata, "$.multimodal_processed") == "false"), "preprocessed").otherwise(status)


def is_namespace(name: Column, suffixes: Sequence[str]) -> Column:
    """Whether a full name ends with one of the namespaces."""
    out = F.lit(False)
    for s in suffixes:
        out = out | name.endswith(s)
    return out


def first_by_path(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first row of each file path."""
    at = F.min(F.struct(*order, *[c for c in df.columns if c not in (*order, "file_path")])).alias("x")
    return df.filter("file_path IS NOT NULL").groupBy("file_path").agg(at).select("file_path", "x.*")


def vector_dump(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """All rows with their vectors and the length of each."""
    return df.withColumn("dim", F.size(vector))


def joined_lists(df: DataFrame) -> DataFrame:
    """Lists of strings as one string each, by which other stores keep them."""
    return df.select(*[F.array_join(c, SEP).alias(c) if k == "array<string>" else F.col(c) for c, k in df.dtypes])


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], now: Column, lists: Sequence[str] = ()) -> DataFrame:
    """old with new rows in place of those of equal keys.

    New keys get create_time, all written rows update_time; a replaced row keeps its time of
    creation. Of `lists`, null becomes the empty list.
    """
    rows = new
    for c in lists:
        rows = rows.withColumn(c, F.coalesce(c, F.array().cast(dict(new.dtypes)[c])))
    known = old.select(*keys, F.col("create_time").alias("__since"))
    rows = rows.join(known, list(keys), "left").withColumn("create_time", F.coalesce("__since", now)).withColumn("update_time", now)
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(rows.select(*old.columns))

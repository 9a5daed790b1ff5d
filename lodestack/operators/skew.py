"""Help against hot keys, for joins of many rows with a lookup that is unique by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_hash(columns: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in columns])


def hot_hashes(df: DataFrame, keys: Sequence[str], parts: int = 64) -> list[int]:
    """Hashes of the keys that hold more than one row in `parts`, found by a frequency sketch.

    By the pigeonhole principle there are fewer than `parts` of them, so the list is
    bounded whatever the size of the data. The sketch is merged map-side: nothing is
    shuffled by key. A wrong member costs time, never correctness.
    """
    sketched = df.select(key_hash(keys).alias("h")).agg(
        F.expr(f"approx_top_k(h, {parts}, {64 * parts})").alias("top"), F.count(F.lit(1)).alias("n")
    )
    row = sketched.first()
    if row is None or not row["n"]:
        return []
    return [x["item"] for x in row["top"] or [] if x["count"] > max(1000, row["n"] / parts)]


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], parts: int = 64, hot: list[int] | None = None) -> DataFrame:
    """Left join of rows to a lookup that is unique by key, safe against hot keys.

    Rows of a hot key stay where they are: their (fewer than `parts`) lookup rows are
    broadcast. All others go through a shuffle join. hot may be given where the same rows
    are joined several times.
    """
    hot = hot_hashes(rows, keys, parts) if hot is None else hot
    if not hot:
        return rows.join(lookup, list(keys), "left")
    is_hot = F.coalesce(key_hash(keys).isin(hot), F.lit(False))
    few = F.broadcast(lookup.filter(is_hot))
    return (
        rows.filter(~is_hot).join(lookup.filter(~is_hot), list(keys), "left")
        .unionByName(rows.filter(is_hot).join(few, list(keys), "left"))
    )

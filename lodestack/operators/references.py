"""References to records that do not exist, or exist only later (problem 2).

Composite keys may be partly null. References are grouped by their null mask and each
group is looked up on its non-null columns, under declared match semantics:

* ``simple``: a reference with a null in any key column is none;
* ``partial``: the non-null columns must agree with some target; an all-null key is none;
* ``full``: an all-null key is none, a partly null key is an orphan.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.skew import lookup_join
from lodestack.session import table

MATCHES = ("simple", "partial", "full")


def orphan_references(
    refs: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    match: str = "full",
    ref_time: str | None = None,
    target_time: str | None = None,
    key_as: dict[str, str] | None = None,
) -> DataFrame:
    """The references without a target (`kind` missing) or with a later one (`kind` late).

    refs keeps all its columns; `keys` name its key columns, key_as maps them to the
    target's where the names differ. A target key that occurs more than once counts from
    its earliest time. Without both times nothing is late; a null time is never late.
    Repeated references come out as often as they go in. An empty target makes every
    reference missing, an empty refs gives no rows.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    if "kind" in refs.columns:
        raise ValueError("refs has a column named kind already")
    key_as = key_as or {}
    hidden = [f"__key_{i}" for i in range(len(keys))]
    timed = ref_time is not None and target_time is not None
    found = targets.select(
        *[F.col(key_as.get(k, k)).alias(h) for k, h in zip(keys, hidden)],
        (F.col(target_time) if timed else F.lit(None).cast("timestamp_ntz")).alias("__since"),
    )
    rows = refs.select("*", *[F.col(k).alias(h) for k, h in zip(keys, hidden)])
    parts = []
    for mask in product((False, True), repeat=len(keys)):
        here = [h for h, null in zip(hidden, mask) if not null]
        if not here or (match == "simple" and any(mask)):
            continue
        group = rows
        for h, null in zip(hidden, mask):
            group = group.filter(F.col(h).isNull() if null else F.col(h).isNotNull())
        if match == "full" and any(mask):
            parts.append(group.withColumn("kind", F.lit("missing")))
            continue
        lookup = (
            found.select(*here, "__since").dropna(subset=here)
            .groupBy(*here).agg(F.min("__since").alias("__since"), F.lit(True).alias("__there"))
        )
        met = lookup_join(group, lookup, here)
        kind = F.when(F.col("__there").isNull(), "missing")
        if timed:
            kind = kind.when(F.col("__since") > F.col(ref_time), "late")
        met = met.withColumn("kind", kind).filter(F.col("kind").isNotNull())
        parts.append(met.drop("__since", "__there"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*refs.columns, "kind")


def _chunk_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "ekr_doc_chunks")
    return chunks.filter("full_doc_id <> ''").select(
        "workspace", F.col("id").alias("row_id"), F.col("full_doc_id").alias("ref_id"), "create_time"
    )


def _relation_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = table(spark, sf_dir, "ekr_vdb_relation")
    return relations.select(
        "workspace", F.col("id").alias("row_id"), F.explode("chunk_ids").alias("ref_id"), "create_time"
    ).filter("ref_id <> ''")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_found: one row per referring row and referenced id that is missing or late."""
    out = None
    for name, refs, target in (
        ("ekr_doc_chunks", _chunk_refs(spark, sf_dir), "ekr_doc_full"),
        ("ekr_vdb_relation", _relation_refs(spark, sf_dir), "ekr_doc_chunks"),
    ):
        targets = table(spark, sf_dir, target).select("workspace", F.col("id").alias("ref_id"), F.col("create_time").alias("since"))
        bad = orphan_references(refs, targets, ["workspace", "ref_id"], "full", "create_time", "since")
        rows = (
            bad.groupBy("workspace", "row_id", "ref_id")
            .agg(F.min("create_time").alias("create_time"), F.max("kind").alias("kind"))
            .select(
                F.lit(name).alias("table_name"), "workspace", "row_id", "ref_id", "kind",
                F.date_format("create_time", "yyyy-MM").alias("period"),
            )
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_report: orphan references counted per table, kind and month."""
    return (
        found(spark, sf_dir).groupBy("table_name", "kind", "period")
        .agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("workspace", "row_id").alias("n_rows"))
    )


FOUND_SQL = """
WITH refs AS (
  SELECT DISTINCT 'ekr_doc_chunks' AS table_name, workspace, id AS row_id, full_doc_id AS ref_id, create_time
  FROM ekr_doc_chunks WHERE full_doc_id <> ''
  UNION ALL
  SELECT DISTINCT 'ekr_vdb_relation', workspace, id, ref_id, create_time
  FROM (SELECT workspace, id, create_time, unnest(chunk_ids) AS ref_id FROM ekr_vdb_relation) WHERE ref_id <> ''
), targets AS (
  SELECT 'ekr_doc_chunks' AS table_name, workspace, id AS ref_id, min(create_time) AS since FROM ekr_doc_full GROUP BY ALL
  UNION ALL
  SELECT 'ekr_vdb_relation', workspace, id, min(create_time) FROM ekr_doc_chunks GROUP BY ALL
), met AS (
  SELECT r.*, t.since, t.ref_id IS NULL AS absent FROM refs r LEFT JOIN targets t USING (table_name, workspace, ref_id)
), found AS (
  SELECT table_name, workspace, row_id, ref_id, max(CASE WHEN absent THEN 'missing' ELSE 'late' END) AS kind,
         strftime(min(create_time), '%Y-%m') AS period
  FROM met WHERE absent OR since > create_time GROUP BY table_name, workspace, row_id, ref_id
)
"""

QUERIES = {"p2_found": found, "p2_report": report}
ORACLES = {
    "p2_found": FOUND_SQL + "SELECT table_name, workspace, row_id, ref_id, kind, period FROM found",
    "p2_report": FOUND_SQL + """
SELECT table_name, kind, period, count(*) AS n_refs, count(DISTINCT (workspace, row_id)) AS n_rows
FROM found GROUP BY table_name, kind, period""",
}

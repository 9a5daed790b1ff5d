"""Views of the data folder's tables that several queries share, in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.graph import canonical
from lodestack.operators.keyvalue import latest
from lodestack.session import table

EPOCH = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', create_time)"


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "ekr_doc_chunks")
    return latest(rows, ["workspace", "id"], [F.col("update_time").desc(), F.col("full_doc_id"), F.col("chunk_order_index")])


def relations(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "ekr_vdb_relation")
    return latest(rows, ["workspace", "id"], [F.col("update_time").desc(), F.col("source_id")])


def docs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "ekr_doc_full")
    return latest(rows, ["workspace", "id"], [F.col("update_time").desc(), F.col("doc_name")])


def status(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "ekr_doc_status")
    return latest(rows, ["workspace", "id"], [F.col("updated_at").desc(), F.col("status")])


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "knowledge_graph_node").select(F.col("id").alias("label")).distinct()


def relation_rows(spark: SparkSession, sf: str) -> DataFrame:
    """src, tgt, weight, keywords, source_ids, path and ord of every relation row."""
    return relations(spark, sf).filter("source_id IS NOT NULL AND target_id IS NOT NULL").select(
        F.col("source_id").alias("src"), F.col("target_id").alias("tgt"), F.lit(1.0).alias("weight"),
        F.split("content", "\t")[0].alias("keywords"), F.col("chunk_ids").alias("source_ids"), "file_path", F.expr(EPOCH).alias("ord"), "id", "workspace", "content",
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """src < tgt and weight, the number of relation rows."""
    return canonical(relation_rows(spark, sf).select("src", "tgt")).groupBy("src", "tgt").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def stub_vectors(spark: SparkSession, sf: str, labels: DataFrame) -> DataFrame:
    """label and the vector that the stand-in embedder gives it: one of the table's, by the label's letters."""
    vectors = table(spark, sf, "embeddings")
    n = vectors.count()
    c = F.col("label")
    number = (F.length(c) * 31 + F.ascii(F.substring(c, 1, 1)) * 17 + F.ascii(F.substring(c, -1, 1)) * 7) % n
    return labels.select("label", number.cast("bigint").alias("vec_id")).join(vectors.select("vec_id", "embedding"), "vec_id").select("label", "embedding")


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The queries of all searches by vector: every vector whose id is divisible by 20."""
    return table(spark, sf, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


QUERY_TERMS = {
    0: ["reservoir", "flood", "station", "flood"], 1: ["ledger", "seal", "archive"], 2: ["turbine", "harbour", "nonexistentterm"],
    3: ["la", "pompe"], 4: ["the", "of", "sediment"],
}


def query_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q, t) for q, terms in QUERY_TERMS.items() for t in terms], "query_id bigint, term string")


SQL = {
    "chunks": """chunks AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY workspace, id
  ORDER BY update_time DESC, full_doc_id NULLS FIRST, chunk_order_index NULLS FIRST) AS rn FROM ekr_doc_chunks) WHERE rn = 1)""",
    "relations": """relations AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY workspace, id
  ORDER BY update_time DESC, source_id NULLS FIRST) AS rn FROM ekr_vdb_relation) WHERE rn = 1)""",
    "docs": """docs AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY workspace, id
  ORDER BY update_time DESC, doc_name NULLS FIRST) AS rn FROM ekr_doc_full) WHERE rn = 1)""",
    "status": """docs_status AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY workspace, id
  ORDER BY updated_at DESC, status NULLS FIRST) AS rn FROM ekr_doc_status) WHERE rn = 1)""",
    "nodes": "nodes AS (SELECT DISTINCT id AS label FROM knowledge_graph_node)",
    "relation_rows": """relation_rows AS (SELECT source_id AS src, target_id AS tgt, 1e0 AS weight, split_part(content, chr(9), 1) AS keywords,
  chunk_ids AS source_ids, file_path, epoch_us(create_time) AS ord, id, workspace, content FROM relations WHERE source_id IS NOT NULL AND target_id IS NOT NULL)""",
    "edges": """edges AS (SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, count(*)::DOUBLE AS weight
  FROM (SELECT src AS src, tgt AS tgt FROM relation_rows WHERE src <> tgt) GROUP BY 1, 2)""",
    "links": "links AS (SELECT src AS a, tgt AS b, weight FROM edges UNION ALL SELECT tgt, src, weight FROM edges)",
    "degrees": "degrees AS (SELECT a AS label, count(*) AS degree FROM links GROUP BY 1)",
    "query_vectors": "query_vectors AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 20 = 0)",
    "query_terms": "query_terms(query_id, term) AS (VALUES " + ", ".join(f"({q}, '{t}')" for q, ts in QUERY_TERMS.items() for t in ts) + ")",
}


def stub_sql(source: str, name: str) -> str:
    """CTE of label and embedding over a CTE with labels."""
    return f"""{name} AS (SELECT x.label, e.embedding FROM {source} x JOIN embeddings e ON e.vec_id =
  (length(x.label) * 31 + ascii(substr(x.label, 1, 1)) * 17 + ascii(right(x.label, 1)) * 7) % (SELECT count(*) FROM embeddings))"""


def cte(*names: str, extra: str = "") -> str:
    """WITH of the named views in order, and of extra ones."""
    need = {"relation_rows": ["relations"], "edges": ["relations", "relation_rows"], "links": ["relations", "relation_rows", "edges"],
            "degrees": ["relations", "relation_rows", "edges", "links"]}
    order: list[str] = []
    for n in names:
        order += [x for x in [*need.get(n, []), n] if x not in order]
    return "WITH " + ",\n".join([SQL[n] for n in order] + ([extra] if extra else [])) + "\n"

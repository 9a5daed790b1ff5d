"""Queries of point access, maintenance, edits, rebuilding, chunking and text cleaning."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import access as ac
from lodestack.operators import ann
from lodestack.operators import chunking as ch
from lodestack.operators import context as cx
from lodestack.operators import graph as g
from lodestack.operators import maintenance as m
from lodestack.operators import resolve as r
from lodestack.operators import search as s
from lodestack.operators import services as sv
from lodestack.operators import strategies as st
from lodestack.plans import strategies as ps
from lodestack.plans import tables as t
from lodestack.plans.book import Book
from lodestack.plans.graphs import NODE_ROWS, RECORDS, _node_rows
from lodestack.session import table

book = Book()


# Point access.
@book.query("get_by_id", t.cte("docs") + "SELECT workspace, id, doc_name FROM docs WHERE id = (SELECT max(id) FROM docs)")
def get_by_id(spark, sf):
    docs = t.docs(spark, sf)
    return docs.join(docs.agg(F.max("id").alias("id")), "id", "left_semi").select("workspace", "id", "doc_name")


@book.query("is_empty", "SELECT (SELECT count(*) FROM ekr_doc_full) = 0 AS is_empty")
def is_empty(spark, sf):
    return ac.is_empty(table(spark, sf, "ekr_doc_full"))


@book.query("has_nodes", t.cte("nodes", "relation_rows", extra="asked AS (SELECT src AS label FROM relation_rows UNION SELECT tgt FROM relation_rows UNION SELECT 'Nobody')")
            + "SELECT a.label, n.label IS NOT NULL AS there FROM asked a LEFT JOIN nodes n ON n.label = a.label")
def has_nodes(spark, sf):
    """Which ends of all relations are nodes."""
    asked = t.relation_rows(spark, sf).select(F.explode(F.array("src", "tgt")).alias("label")).unionByName(spark.createDataFrame([("Nobody",)], "label string"))
    return ac.has_nodes(t.nodes(spark, sf), asked)


@book.query("docs_by_track", t.cte("status") + """
SELECT track_id, workspace, id, row_number() OVER (PARTITION BY track_id ORDER BY created_at, id, workspace) AS pos FROM docs_status WHERE track_id IS NOT NULL""")
def docs_by_track(spark, sf):
    """The documents of every track id in order of creation."""
    rows = t.status(spark, sf).filter("track_id IS NOT NULL")
    return s.top(rows, ["track_id"], [F.col("created_at"), F.col("id"), F.col("workspace")], 2**31 - 1).select("track_id", "workspace", "id", F.col("rank").alias("pos"))


@book.query("docs_by_ids", t.cte("docs", "chunks") + "SELECT workspace, id, doc_name FROM docs WHERE (workspace, id) IN (SELECT (workspace, full_doc_id) FROM chunks WHERE full_doc_id IS NOT NULL)")
def docs_by_ids(spark, sf):
    """The documents that chunks name; ids without a document give nothing."""
    wanted = t.chunks(spark, sf).select("workspace", F.col("full_doc_id").alias("id"))
    return ac.found_by_ids(t.docs(spark, sf).select("workspace", "id", "doc_name"), wanted, ["workspace", "id"])


@book.query("meta_fields", t.cte("chunks") + "SELECT id, full_doc_id, file_path FROM chunks")
def meta_fields(spark, sf):
    return ac.meta_fields(t.chunks(spark, sf), ["full_doc_id", "file_path", "no_such_field"])


@book.query("user_entities", "WITH " + NODE_ROWS + """
SELECT name AS label, coalesce(type, 'UNKNOWN') AS type, coalesce(description, '') AS description, coalesce(source_id, '') AS source_id, coalesce(file_path, 'unknown_source') AS file_path FROM node_rows""")
def user_entities(spark, sf):
    return ac.user_entities(_node_rows(spark, sf).withColumnRenamed("name", "label"))


@book.query("user_relations", t.cte("relations") + """
SELECT source_id AS src, target_id AS tgt, coalesce(content, '') AS description, '' AS keywords, 1e0 AS weight, coalesce(id, '') AS source_id, coalesce(file_path, 'unknown_source') AS file_path FROM relations""")
def user_relations(spark, sf):
    rows = t.relations(spark, sf).select(
        F.col("source_id").alias("src"), F.col("target_id").alias("tgt"), F.col("content").alias("description"), F.lit(None).cast("string").alias("keywords"),
        F.lit(None).cast("double").alias("weight"), F.col("id").alias("source_id"), "file_path")
    return ac.user_relations(rows)


@book.query("entity_info", t.cte("nodes", extra=t.stub_sql("nodes", "v")) + "SELECT label, embedding[1]::DOUBLE AS first, len(embedding) AS dim FROM nodes JOIN v USING (label)")
def entity_info(spark, sf):
    """Every node with its stored vector."""
    nodes = t.nodes(spark, sf)
    return ac.entity_info(nodes, t.stub_vectors(spark, sf, nodes), nodes).select("label", F.col("embedding")[0].cast("double").alias("first"), F.size("embedding").cast("bigint").alias("dim"))


@book.query("relation_info", t.cte("relation_rows", "edges") + """
SELECT src, tgt, weight FROM edges WHERE (src, tgt) IN (SELECT (least(src, tgt), greatest(src, tgt)) FROM (SELECT src AS src, tgt AS tgt FROM relation_rows WHERE length(src) % 2 = 0))""")
def relation_info(spark, sf):
    """The edges of all pairs whose first name in some relation row has an even length, from either end."""
    asked = t.relation_rows(spark, sf).filter("length(src) % 2 = 0").select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))
    return ac.relation_info(t.edges(spark, sf), None, asked).select("src", "tgt", "weight")


@book.query("typed_lists", t.cte("chunks") + "SELECT workspace, id, id AS chunk_id, content FROM chunks")
def typed_lists(spark, sf):
    """Raw results as JSON, read into typed lists without their unknown fields."""
    from pyspark.sql import types as P

    fields = P.StructType([P.StructField("chunk_id", P.StringType()), P.StructField("content", P.StringType())])
    item = F.struct(F.col("id").alias("chunk_id"), "content", F.lit(1).alias("unknown"))
    raw = t.chunks(spark, sf).select("workspace", "id", F.to_json(F.struct(F.struct(F.array(item).alias("chunks"), F.lit("x").alias("other")).alias("data"))).alias("raw"))
    rows = ac.typed_lists(raw, "raw", {"chunks": fields, "entities": fields})
    return rows.filter("size(entities) = 0").select("workspace", "id", F.inline("chunks"))


@book.query("shown_status", t.cte("status") + """
SELECT workspace, id, CASE WHEN status = 'processed' AND chunks_count % 2 = 0 THEN 'preprocessed' ELSE status END AS status FROM docs_status""")
def shown_status(spark, sf):
    """States as shown while images wait (here of documents with an even number of chunks)."""
    meta = F.to_json(F.struct((F.col("chunks_count") % 2 != 0).alias("multimodal_processed")))
    return t.status(spark, sf).select("workspace", "id", ac.shown_status(F.col("status"), meta).alias("status"))


@book.query("namespace_suffix", t.cte("status") + "SELECT DISTINCT workspace || '_' || status AS name, status IN ('failed', 'processed') AS is_it FROM docs_status")
def namespace_suffix(spark, sf):
    rows = t.status(spark, sf).select(F.concat_ws("_", "workspace", "status").alias("name")).distinct()
    return rows.select("name", ac.is_namespace(F.col("name"), ["_failed", "_processed"]).alias("is_it"))


@book.query("vector_dump", "SELECT vec_id, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 6) AS size FROM embeddings")
def vector_dump(spark, sf):
    rows = ac.vector_dump(table(spark, sf, "embeddings"))
    size = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.round(size, 6).alias("size"))


@book.query("upsert_times", t.cte("docs", extra="""
old AS (SELECT workspace, id, doc_name, create_time, update_time FROM docs WHERE create_time < TIMESTAMP '2024-07-01'),
new AS (SELECT workspace, id, 'new' AS doc_name FROM docs WHERE create_time >= TIMESTAMP '2024-04-01')""") + """
SELECT n.workspace, n.id, n.doc_name, coalesce(o.create_time, TIMESTAMP '2026-01-01') AS create_time, TIMESTAMP '2026-01-01' AS update_time FROM new n LEFT JOIN old o USING (workspace, id)
UNION ALL SELECT * FROM old WHERE (workspace, id) NOT IN (SELECT (workspace, id) FROM new)""")
def upsert_times(spark, sf):
    """Replaced rows keep their time of creation, all written ones get a new time of change."""
    docs = t.docs(spark, sf).select("workspace", "id", "doc_name", "create_time", "update_time")
    new = docs.filter("create_time >= TIMESTAMP_NTZ '2024-04-01'").select("workspace", "id", F.lit("new").alias("doc_name"))
    return ac.upserted(docs.filter("create_time < TIMESTAMP_NTZ '2024-07-01'"), new, ["workspace", "id"], F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00'"))


HUB = "hub AS (SELECT label FROM degrees ORDER BY degree DESC, label LIMIT 1)"


def _hub(spark, sf):
    return g.degrees(t.edges(spark, sf)).orderBy(F.desc("degree"), "label").limit(1).select("label")


@book.query("delete_relation_vectors", t.cte("degrees", extra=HUB) + "SELECT src, tgt FROM edges WHERE src NOT IN (SELECT label FROM hub) AND tgt NOT IN (SELECT label FROM hub)")
def delete_relation_vectors(spark, sf):
    """The relation vectors that stay when those of the largest hub go."""
    return m.without_vectors_of(t.edges(spark, sf).select("src", "tgt"), _hub(spark, sf))


@book.query("remove_nodes", t.cte("degrees", "nodes", extra=HUB) + "SELECT label FROM nodes WHERE label NOT IN (SELECT label FROM hub)")
def remove_nodes(spark, sf):
    return m.without_entities(t.nodes(spark, sf), t.edges(spark, sf), _hub(spark, sf))[0]


@book.query("remove_relations", t.cte("relation_rows", "edges") + """
SELECT src, tgt, weight FROM edges WHERE (src, tgt) NOT IN (SELECT (least(src, tgt), greatest(src, tgt)) FROM (SELECT src AS src, tgt AS tgt FROM relation_rows WHERE length(src) % 2 = 0))""")
def remove_relations(spark, sf):
    return m.without_relations(t.edges(spark, sf), t.relation_rows(spark, sf).filter("length(src) % 2 = 0").select("src", "tgt"))


# Edits.
@book.query("edit_entities", "WITH " + NODE_ROWS + """,
n AS (SELECT name AS label, min(type) AS type, max(description) AS description FROM node_rows GROUP BY 1)
SELECT label, CASE WHEN type = 'person' THEN 'human' ELSE type END AS type, description FROM n""")
def edit_entities(spark, sf):
    """All persons get another type; a null in a change leaves the value."""
    nodes = _node_rows(spark, sf).groupBy(F.col("name").alias("label")).agg(F.min("type").alias("type"), F.max("description").alias("description"))
    changes = nodes.filter("type = 'person'").select("label", F.lit("human").alias("type"), F.lit(None).cast("string").alias("description"))
    return m.edited(nodes, changes, ["label"])


@book.query("edit_relations", t.cte("edges") + "SELECT src, tgt, CASE WHEN weight > 1 THEN 9e0 ELSE weight END AS weight FROM edges")
def edit_relations(spark, sf):
    edges = t.edges(spark, sf)
    return m.edited(edges, edges.filter("weight > 1").select("src", "tgt", F.lit(9.0).alias("weight")), ["src", "tgt"])


@book.query("create_relations", t.cte("degrees", "nodes", extra=HUB + """,
new AS (SELECT least(h.label, n.label) AS src, greatest(h.label, n.label) AS tgt, 1e0 AS weight FROM hub h, nodes n WHERE h.label <> n.label)""") + """
SELECT src, tgt, weight FROM edges UNION ALL SELECT * FROM new WHERE (src, tgt) NOT IN (SELECT (src, tgt) FROM edges) AND (SELECT label FROM hub) IN (SELECT label FROM nodes)""")
def create_relations(spark, sf):
    """Edges from the largest hub to every node that it has none to yet."""
    edges, nodes, hub = t.edges(spark, sf), t.nodes(spark, sf), _hub(spark, sf)
    there = F.broadcast(hub.join(nodes, "label", "left_semi").withColumnRenamed("label", "src"))
    new = g.canonical(nodes.withColumnRenamed("label", "tgt").crossJoin(there)).withColumn("weight", F.lit(1.0)).join(edges.select("src", "tgt"), ["src", "tgt"], "left_anti")
    return m.created_relations(nodes, edges, new)


MERGE_SQL = """n AS (SELECT name AS label, min(type) AS type, max(description) AS description, max(source_id) AS source_id FROM node_rows GROUP BY 1),
mapping AS (SELECT label, first_value(label) OVER (PARTITION BY split_part(lower(label), ' ', 1) ORDER BY label) AS target FROM n)"""


def _merge_input(spark, sf):
    nodes = _node_rows(spark, sf).groupBy(F.col("name").alias("label")).agg(F.min("type").alias("type"), F.max("description").alias("description"), F.max("source_id").alias("source_id"))
    keyed = nodes.select("label", F.split_part(F.lower("label"), F.lit(" "), F.lit(1)).alias("k"))
    mapping = keyed.join(keyed.groupBy("k").agg(F.min("label").alias("target")), "k").select("label", "target")
    edges = t.edges(spark, sf).withColumn("description", F.concat_ws("-", "src", "tgt")).withColumn("keywords", F.lit("b, a")).withColumn("source_id", F.col("src"))
    return nodes, edges, mapping


@book.query("merge_entities_nodes", "WITH " + NODE_ROWS + ",\n" + MERGE_SQL + """,
x AS (SELECT n.*, target AS name, (label <> target) AS other FROM n JOIN mapping USING (label)),
pieces AS (SELECT name, s, min((other, label, i)) AS o FROM (SELECT name, other, label, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT name, other, label, string_split(source_id, '<SEP>') AS l FROM x WHERE source_id <> '')) GROUP BY 1, 2)
SELECT name AS label, arg_min(type, (other, label)) FILTER (WHERE type <> '') AS type, coalesce(string_agg(description, '<SEP>' ORDER BY other, label) FILTER (WHERE description <> ''), '') AS description,
  coalesce((SELECT string_agg(s, '<SEP>' ORDER BY o) FROM pieces WHERE pieces.name = x.name), '') AS source_id FROM x GROUP BY name""")
def merge_entities_nodes(spark, sf):
    """Nodes after all with the same first word were merged into the first of them."""
    return m.merged_entities(*_merge_input(spark, sf))[0]


@book.query("merge_entities_edges", t.cte("edges", extra=NODE_ROWS + ",\n" + MERGE_SQL + """,
moved AS (SELECT coalesce(a.target, src) AS s, coalesce(b.target, tgt) AS d, weight, src, tgt FROM edges LEFT JOIN mapping a ON a.label = src LEFT JOIN mapping b ON b.label = tgt),
c AS (SELECT least(s, d) AS src, greatest(s, d) AS tgt, weight, src || '-' || tgt AS description FROM (SELECT s, d, weight, src, tgt FROM moved) WHERE s <> d)""") + """
SELECT src, tgt, max(weight) AS weight, 'a,b' AS keywords, count(*) AS n_descriptions FROM c GROUP BY 1, 2""")
def merge_entities_edges(spark, sf):
    """Edges after that: the largest weight, keywords united, descriptions joined."""
    edges = m.merged_entities(*_merge_input(spark, sf))[1]
    return edges.select("src", "tgt", "weight", "keywords", F.size(F.split("description", "<SEP>")).cast("bigint").alias("n_descriptions"))


@book.query("attribute_merges", "WITH " + NODE_ROWS + """,
d AS (SELECT type AS k, description AS v, min((ord, name)) AS o FROM node_rows WHERE description <> '' GROUP BY 1, 2),
p AS (SELECT type AS k, file_path AS v, min((ord, name)) AS o FROM node_rows WHERE file_path <> '' GROUP BY 1, 2)
SELECT k, md5(coalesce((SELECT string_agg(v, '<SEP>' ORDER BY o) FROM d WHERE d.k = t.k), '')) AS descriptions, md5(coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM p WHERE p.k = t.k), '')) AS paths,
  (SELECT CAST(sum(len(list_filter(string_split(file_path, '<SEP>'), lambda x: x <> ''))) AS BIGINT) FROM node_rows n WHERE n.type = t.k AND file_path <> '') AS n_all FROM (SELECT DISTINCT type AS k FROM node_rows) t""")
def attribute_merges(spark, sf):
    """Descriptions of a type joined once each in order, paths as a sorted list, and all paths one after the other."""
    rows = _node_rows(spark, sf).withColumn("o", F.struct("ord", "name"))
    count = F.size(F.filter(F.split(r.merged_attribute("file_path", "o", "concatenate"), "<SEP>"), lambda x: x != "")).cast("bigint")
    return rows.groupBy(F.col("type").alias("k")).agg(
        F.md5(r.merged_attribute("description", "o", "join_unique")).alias("descriptions"), F.md5(r.merged_attribute("file_path", "o", "join_unique_comma")).alias("paths"), count.alias("n_all"))


# Tracking, deletes and rebuilding.
@book.query("document_index", t.cte("chunks", "relation_rows", extra="""
ends AS (SELECT unnest([src, tgt]) AS label, workspace, source_ids FROM relation_rows), each_source AS (SELECT DISTINCT label, workspace, c FROM (SELECT label, workspace, unnest(source_ids) AS c FROM ends) WHERE c <> '')""") + """
SELECT DISTINCT c.workspace, full_doc_id, label FROM each_source e JOIN chunks c ON c.workspace = e.workspace AND c.id = e.c WHERE full_doc_id <> ''""")
def document_index(spark, sf):
    """The entities of every document."""
    ends = t.relation_rows(spark, sf).select(F.explode(F.array("src", "tgt")).alias("label"), "workspace", "source_ids")
    sources = ends.select("label", "workspace", F.explode("source_ids").alias("chunk_id")).filter("chunk_id <> ''").distinct()
    return m.document_index(t.chunks(spark, sf), sources, ["label"])


@book.query("document_relations", t.cte("chunks", "relation_rows", extra="""
each_source AS (SELECT DISTINCT least(src, tgt) AS src, greatest(src, tgt) AS tgt, workspace, c FROM (SELECT src AS src, tgt AS tgt, workspace, unnest(source_ids) AS c FROM relation_rows WHERE src <> tgt) WHERE c <> ''),
i AS (SELECT DISTINCT c.workspace, full_doc_id, src, tgt FROM each_source e JOIN chunks c ON c.workspace = e.workspace AND c.id = e.c WHERE full_doc_id <> '')""") + """
SELECT workspace, full_doc_id, count(*) AS n_relations FROM i GROUP BY 1, 2""")
def document_relations(spark, sf):
    """How many relations every document has."""
    rows = g.canonical(t.relation_rows(spark, sf).select("src", "tgt", "workspace", "source_ids"))
    sources = rows.select("src", "tgt", "workspace", F.explode("source_ids").alias("chunk_id")).filter("chunk_id <> ''").distinct()
    return m.document_index(t.chunks(spark, sf), sources, ["src", "tgt"]).groupBy("workspace", "full_doc_id").agg(F.count(F.lit(1)).alias("n_relations"))


ENTITY_SOURCES = """each_row AS (SELECT unnest([src, tgt]) AS label, ord, source_ids FROM relation_rows),
e AS (SELECT label, c AS chunk_id, min(ord) AS ord FROM (SELECT label, ord, unnest(source_ids) AS c FROM each_row) WHERE c <> '' GROUP BY 1, 2)"""


def _entity_sources(spark, sf):
    rows = t.relation_rows(spark, sf).select(F.explode(F.array("src", "tgt")).alias("label"), "ord", "source_ids")
    return rows.select("label", "ord", F.explode("source_ids").alias("chunk_id"))


@book.query("backfill_tracking", t.cte("relation_rows", extra=ENTITY_SOURCES) + "SELECT label, chunk_id, row_number() OVER (PARTITION BY label ORDER BY ord, chunk_id) AS pos FROM e")
def backfill_tracking(spark, sf):
    """The tracking table of entities, of which half were there already."""
    sources = _entity_sources(spark, sf)
    present = m.tracking(sources.filter(F.length("label") % 2 == 0), ["label"])
    return m.backfilled(present, sources, ["label"])


@book.query("kept_rows", t.cte("relation_rows", extra=ENTITY_SOURCES) + "SELECT label, chunk_id FROM (SELECT label, chunk_id, row_number() OVER (PARTITION BY label ORDER BY ord, chunk_id) AS n FROM e) WHERE n <= 3")
def kept_rows(spark, sf):
    """The rows of the first three chunks of each entity, as the cap that keeps the first leaves them."""
    sources = _entity_sources(spark, sf).filter("chunk_id <> ''")
    return m.within_kept_sources(sources.select("label", "chunk_id").distinct(), m.kept_sources(sources, ["label"], 3, r.KEEP), ["label"])


@book.query("endpoint_sources", t.cte("relation_rows", extra=NODE_ROWS + ",\n" + ENTITY_SOURCES) + """
SELECT label, count(DISTINCT chunk_id) AS n_sources FROM (SELECT label, chunk_id FROM e UNION ALL SELECT name, source_id FROM node_rows WHERE source_id <> '') GROUP BY 1""")
def endpoint_sources(spark, sf):
    """How many chunks each end of an edge or node comes from once edges have added theirs."""
    own = _node_rows(spark, sf).select(F.col("name").alias("label"), F.col("source_id").alias("chunk_id"))
    both = own.unionByName(_entity_sources(spark, sf).select("label", "chunk_id")).filter("chunk_id <> ''").distinct()
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n_sources"))


@book.query("cache_lists", t.cte("chunks", extra="""
refs AS (SELECT workspace, id AS chunk_id, unnest(llm_cache_list) AS cache_id FROM chunks UNION SELECT c.workspace, c.id, l.id FROM chunks c JOIN ekr_llm_cache l ON l.workspace = c.workspace AND l.chunk_id = c.id),
calls AS (SELECT workspace, id AS cache_id, min(create_time) AS since FROM ekr_llm_cache WHERE cache_type = 'extract' GROUP BY 1, 2),
met AS (SELECT DISTINCT r.workspace, r.chunk_id, cache_id, since FROM refs r JOIN calls USING (workspace, cache_id))""") + """
SELECT workspace, chunk_id, cache_id, row_number() OVER (PARTITION BY workspace, chunk_id ORDER BY since, cache_id) AS rank, min(since) OVER (PARTITION BY workspace, chunk_id) AS first FROM met""")
def cache_lists(spark, sf):
    """The cached extractions that chunks list or that name a chunk, oldest first, with the time of the chunk's first."""
    calls = table(spark, sf, "ekr_llm_cache").filter("cache_type = 'extract'").groupBy("workspace", F.col("id").alias("cache_id")).agg(F.min("create_time").alias("at"))
    chunks = t.chunks(spark, sf).select("workspace", F.col("id").alias("chunk_id"), "llm_cache_list")
    named = table(spark, sf, "ekr_llm_cache").select("workspace", "chunk_id", F.col("id").alias("cache_id")).join(chunks.select("workspace", "chunk_id"), ["workspace", "chunk_id"], "left_semi")
    # A union here would be wrong: Spark 4.1 counts on its partitioning, which adaptive execution changes.
    listed = chunks.select("workspace", "chunk_id", F.explode("llm_cache_list").alias("cache_id"))
    refs = listed.distinct().join(named.distinct(), ["workspace", "chunk_id", "cache_id"], "full_outer")
    met = refs.join(calls, ["workspace", "cache_id"]).withColumn("first", F.min("at").over(W.partitionBy("workspace", "chunk_id")))
    return s.top(met, ["workspace", "chunk_id"], [F.col("at").asc_nulls_last(), F.col("cache_id")], 2**31 - 1).select("workspace", "chunk_id", "cache_id", "rank", "first")


RECORD_ROWS = RECORDS.replace("SELECT DISTINCT workspace, id, return_value FROM", "SELECT workspace || '/' || chunk_id AS workspace, id, return_value, min(epoch_us(create_time)) AS ord FROM").replace(
    "return_value IS NOT NULL)", "return_value IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2, 3)", 1
).replace("SELECT workspace, id, return_value, unnest(l)", "SELECT workspace, id, return_value, ord, unnest(l)").replace("FROM (SELECT workspace, id, return_value, regexp", "FROM (SELECT workspace, id, return_value, ord, regexp").replace(
    "fields AS (SELECT workspace, id,", "fields AS (SELECT workspace AS chunk_id, ord,"
)
REBUILD_SQL = RECORD_ROWS + """,
gone AS (SELECT DISTINCT workspace || '/' || id AS chunk_id FROM ekr_doc_chunks WHERE right(full_doc_id, 1) IN ('0', '1', '2', '3')),
named AS (SELECT chunk_id, ord, i, f[2] AS name, replace(lower(f[3]), ' ', '') AS type, f[4] AS description FROM fields WHERE len(f) = 4 AND contains(lower(f[1]), 'entity') AND f[2] <> '' AND f[3] <> '' AND f[4] <> ''
  AND NOT regexp_matches(f[3], '[''"()<>|/\\\\]')),
ent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, chunk_id ORDER BY length(description) DESC, ord, i, description) AS n FROM named) WHERE n = 1 AND chunk_id NOT IN (SELECT chunk_id FROM gone)),
paired AS (SELECT chunk_id, ord, i, least(f[2], f[3]) AS src, greatest(f[2], f[3]) AS tgt, f[5] AS description, CASE WHEN regexp_matches(f[5], '^[-+]?[0-9]*\\.?[0-9]+$') THEN f[5]::DOUBLE ELSE 1e0 END AS weight
  FROM fields WHERE len(f) = 5 AND contains(lower(f[1]), 'relation') AND f[2] <> '' AND f[3] <> '' AND f[2] <> f[3]),
rel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, tgt, chunk_id ORDER BY length(description) DESC, ord, i, description) AS n FROM paired) WHERE n = 1 AND chunk_id NOT IN (SELECT chunk_id FROM gone))"""


def _rebuild(spark, sf):
    key = F.concat_ws("/", "workspace", "chunk_id")
    cache = table(spark, sf, "ekr_llm_cache").filter("cache_type = 'extract' AND chunk_id IS NOT NULL").groupBy("id", key.alias("chunk_id"), "return_value").agg(F.min(F.expr(t.EPOCH)).alias("ord"))
    chunks = cache.select("chunk_id", F.lit(None).cast("string").alias("file_path")).distinct()
    records = m.extracted(cache, chunks)
    nodes, edges = m.built(records)
    gone = table(spark, sf, "ekr_doc_chunks").filter(F.substring("full_doc_id", -1, 1).isin("0", "1", "2", "3")).select(F.concat_ws("/", "workspace", "id").alias("chunk_id"))
    return m.rebuilt_after_delete(records, nodes, edges, gone)


@book.query("rebuild_nodes", "WITH " + REBUILD_SQL + """,
votes AS (SELECT name, type FROM (SELECT name, type, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, min(ord), type DESC) AS rn FROM ent GROUP BY name, type) WHERE rn = 1),
d AS (SELECT name, string_agg(v, '<SEP>' ORDER BY o, length(v) DESC, v) AS description FROM (SELECT name, description AS v, min(ord) AS o FROM ent GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT name, count(DISTINCT chunk_id) AS n_chunks FROM ent GROUP BY 1)
SELECT name, type, description, n_chunks FROM votes JOIN d USING (name) JOIN c USING (name)""")
def rebuild_nodes(spark, sf):
    """Nodes after a fourth of the documents was deleted: as if they had never been read."""
    return _rebuild(spark, sf)[0].select("name", "type", "description", F.size("chunk_ids").cast("bigint").alias("n_chunks"))


@book.query("rebuild_edges", "WITH " + REBUILD_SQL + """,
d AS (SELECT src, tgt, string_agg(v, '<SEP>' ORDER BY o, length(v) DESC, v) AS description FROM (SELECT src, tgt, description AS v, min(ord) AS o FROM rel WHERE description <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT src, tgt, weight, description, n_chunks FROM (SELECT src, tgt, sum(weight) AS weight, count(DISTINCT chunk_id) AS n_chunks FROM rel GROUP BY 1, 2) LEFT JOIN d USING (src, tgt)""")
def rebuild_edges(spark, sf):
    return _rebuild(spark, sf)[1].select("src", "tgt", "weight", "description", F.size("chunk_ids").cast("bigint").alias("n_chunks"))


@book.query("replace_versions", t.cte("docs", extra="""
stored AS (SELECT workspace, id, doc_name AS file_path FROM docs WHERE doc_name IS NOT NULL), incoming AS (SELECT workspace, CASE WHEN right(id, 1) < '8' THEN 'doc-new' || right(id, 6) ELSE id END AS id, file_path FROM stored)""") + """
SELECT workspace, id FROM stored WHERE (workspace, file_path) IN (SELECT (workspace, file_path) FROM incoming WHERE (workspace, id) NOT IN (SELECT (workspace, id) FROM stored))""")
def replace_versions(spark, sf):
    """The stored documents that new versions of the same path replace; equal contents replace nothing."""
    stored = t.docs(spark, sf).filter("doc_name IS NOT NULL").select("workspace", "id", F.col("doc_name").alias("file_path"))
    new = F.when(F.substring("id", -1, 1) < "8", F.concat(F.lit("doc-new"), F.substring("id", -6, 6))).otherwise(F.col("id"))
    return m.new_version(stored, stored.withColumn("id", new))[0]


# Chunks, labels and searches.
@book.query("chunk_split_windows", t.cte("docs", extra="""
parts AS (SELECT workspace, id, string_split(content, '## ') AS p FROM docs WHERE content IS NOT NULL),
pieces AS (SELECT workspace, id, i, CASE WHEN i = 1 THEN p[i] ELSE '## ' || p[i] END AS content FROM (SELECT workspace, id, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
sized AS (SELECT *, regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+') AS w FROM pieces),
placed AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY workspace, id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized),
cut AS (SELECT workspace, id, i, 0 AS s, len(w) AS n_tokens, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS content, before AS start FROM placed WHERE len(w) <= 40
  UNION ALL SELECT workspace, id, i, s, least(40, len(w) - s), array_to_string(list_slice(w, s + 1, s + 40), ' '), before + s FROM (SELECT *, unnest(range(0, len(w), 30)) AS s FROM placed WHERE len(w) > 40))""") + """
SELECT workspace, id, row_number() OVER (PARTITION BY workspace, id ORDER BY i, s) - 1 AS chunk_order_index, n_tokens::BIGINT AS n_tokens, content, start::BIGINT AS start, (start // 50 + 1)::BIGINT AS page_start FROM cut WHERE content <> ''""")
def chunk_split_windows(spark, sf):
    """Sections, those over 40 words as windows that overlap by ten, with the page of 50 words each starts on."""
    docs = t.docs(spark, sf).filter("content IS NOT NULL").select("workspace", "id", "content")
    n = F.size(T.words("content"))
    docs = docs.withColumn("ends", F.transform(F.sequence(F.lit(50), n + 50, F.lit(50)), lambda e: e))
    return ch.split_then_window(docs, "content", "## ", 40, 10, "ends")


@book.query("chunk_dedupe", t.cte("chunks", extra="first AS (SELECT content, min((workspace, id)) AS o FROM chunks WHERE content IS NOT NULL GROUP BY 1)") + """
SELECT 'DC' || row_number() OVER (ORDER BY o) AS dc_id, o[1] AS workspace, o[2] AS id FROM first""".replace("o[1]", "o[1]"))
def chunk_dedupe(spark, sf):
    """Distinct contents in order of their first chunk, numbered."""
    rows = t.chunks(spark, sf).filter("content IS NOT NULL").groupBy(F.md5("content").alias("h"), "content").agg(F.min(F.struct("workspace", "id")).alias("o"))
    return s.numbered(rows.select("o.workspace", "o.id"), ["workspace", "id"], "n").select(F.concat(F.lit("DC"), "n").alias("dc_id"), "workspace", "id")


@book.query("all_labels", t.cte("nodes") + "SELECT label, row_number() OVER (ORDER BY lower(label), label) AS pos FROM nodes")
def all_labels(spark, sf):
    """All labels in order, ignoring case."""
    return s.numbered(t.nodes(spark, sf).withColumn("low", F.lower("label")), ["low", "label"], "pos").select("label", "pos")


@book.query("bounded_bfs", t.cte("degrees", extra="""
l0 AS (SELECT label, degree FROM degrees ORDER BY degree, label LIMIT 1),
l1 AS (SELECT d.label, d.degree FROM degrees d WHERE d.label IN (SELECT b FROM links JOIN l0 ON l0.label = a) AND d.label NOT IN (SELECT label FROM l0) ORDER BY d.degree DESC, d.label LIMIT 119),
l2 AS (SELECT d.label, d.degree FROM degrees d WHERE d.label IN (SELECT b FROM links JOIN l1 ON l1.label = a) AND d.label NOT IN (SELECT label FROM l0 UNION SELECT label FROM l1)
  ORDER BY d.degree DESC, d.label LIMIT (SELECT greatest(0, 119 - count(*)) FROM l1)),
l3 AS (SELECT d.label, d.degree FROM degrees d WHERE d.label IN (SELECT b FROM links JOIN l2 ON l2.label = a) AND d.label NOT IN (SELECT label FROM l0 UNION SELECT label FROM l1 UNION SELECT label FROM l2)
  ORDER BY d.degree DESC, d.label LIMIT (SELECT greatest(0, 119 - (SELECT count(*) FROM l1) - count(*)) FROM l2))""") + """
SELECT label, 0 AS depth, degree FROM l0 UNION ALL SELECT label, 1, degree FROM l1 UNION ALL SELECT label, 2, degree FROM l2 UNION ALL SELECT label, 3, degree FROM l3""")
def bounded_bfs(spark, sf):
    """At most 120 nodes within three hops of the first label of least degree, level by level, high degrees first."""
    edges = t.edges(spark, sf)
    start = g.degrees(edges).orderBy("degree", "label").limit(1).collect()
    return g.bounded_search(edges, start[0]["label"] if start else "", 3, 120)


@book.query("strategy_naive_rerank", t.cte(*ps.VIEWS, extra=ps.STORE_SQL + ",\n" + ps._dense_sql("wide", "chunk_vectors", "label AS chunk_id", "label", 2 * ps.K) + ",\n" + ps.TERMS_SQL + """,
asked AS (SELECT query_id, list_distinct(list(term)) AS q FROM query_terms GROUP BY 1),
scored AS (SELECT query_id, chunk_id, rank, len(list_intersect(q, list_distinct(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+'))))::DOUBLE / len(q) AS score FROM wide JOIN chunk_rows ON label = chunk_id JOIN asked USING (query_id))""") + f"""
SELECT query_id, 'chunk' AS what, chunk_id AS key, rank, source FROM (SELECT query_id, chunk_id, 'C1/' || rank AS source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM scored) WHERE rank <= {ps.K}""")
def strategy_naive_rerank(spark, sf):
    """Twice as many chunks by vector, reranked down to the wanted number."""
    return ps.rows_of(st.strategy("naive")(ps.store(spark, sf), t.query_vectors(spark, sf), ps.options(rerank=s.overlap_score), ps.questions(spark, sf)))


@book.query("rerank_outage", ps.PLAIN + "SELECT query_id, chunk_id, rank FROM chunk_hits WHERE rank <= 3")
def rerank_outage(spark, sf):
    """A reranker that fails for every query leaves the first chunks in their order."""
    sto = ps.store(spark, sf)
    hits = st.dense_chunks(sto, t.query_vectors(spark, sf), ps.K).drop("score").join(sto.chunks.select("chunk_id", "content"), "chunk_id").withColumn("question", F.lit("x"))

    def broken(question, contents, top_n):
        raise TimeoutError("no answer")

    scored = sv.rerank_column(hits, "question", "content", broken)
    return s.reranked(scored.withColumnRenamed("rerank_score", "given"), F.col("given"), 3).select("query_id", "chunk_id", "rank")


@book.query("ann_topk")
def ann_topk(spark, sf):
    """The ten best of every query by lists around centres; recall is tested against brute force."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    lists = ann.fitted(rows, "embedding")
    return ann.search(ann.indexed(rows, "embedding", lists), lists, t.query_vectors(spark, sf), "vec_id", "embedding", 10, max(1, len(lists.centres) // 3)).select("query_id", "vec_id", "rank")


@book.query("subquery_keywords", t.cte("query_terms", extra="numbered AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY term) AS pos FROM query_terms)") + """
SELECT question_id, string_agg(term, ',' ORDER BY o) AS keywords, count(*) AS n FROM (SELECT query_id % 2 AS question_id, term, min((query_id, pos)) AS o FROM numbered GROUP BY 1, 2) GROUP BY 1""")
def subquery_keywords(spark, sf):
    """Keywords of sub-queries as one ordered list a question."""
    rows = s.top(t.query_terms(spark), ["query_id"], [F.col("term")], 100)
    rows = rows.select((F.col("query_id") % 2).alias("question_id"), F.col("query_id").alias("sub"), F.lit("low").alias("level"), F.col("rank").alias("pos"), F.col("term").alias("keyword"))
    return cx.merged_keywords(rows).select("question_id", F.array_join("keywords", ",").alias("keywords"), F.size("keywords").cast("bigint").alias("n"))


@book.query("subquery_info", t.cte("query_terms") + "SELECT query_id % 2 AS question_id, 'n_terms' AS name, count(*) AS value FROM query_terms GROUP BY 1")
def subquery_info(spark, sf):
    rows = t.query_terms(spark).groupBy("query_id").agg(F.count(F.lit(1)).alias("value"))
    return cx.summed_info(rows.select((F.col("query_id") % 2).alias("question_id"), F.lit("n_terms").alias("name"), "value"))


# Text and calls.
@book.query("text_cleaning", """
SELECT doc_id, md5(regexp_replace(text, '[\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{7F}-\\x{9F}\\x{FFFE}\\x{FFFF}]', '', 'g')) AS plain, CASE WHEN upper(trim(coalesce(source, ''))) IN ('KEEP', 'FIFO') THEN upper(trim(source)) ELSE 'FIFO' END AS method,
  strftime(to_timestamp(doc_id * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at, CASE WHEN starts_with(text, coalesce(source, '')) AND source <> '' THEN TRUE ELSE FALSE END AS echoes FROM documents WHERE text IS NOT NULL""")
def text_cleaning(spark, sf):
    docs = table(spark, sf, "documents").filter("text IS NOT NULL")
    return docs.select(
        "doc_id", F.md5(T.without_control("text")).alias("plain"), T.limit_method(F.coalesce("source", F.lit(""))).alias("method"), T.epoch_text(F.col("doc_id") * 86400).alias("at"),
        F.coalesce(F.startswith("text", F.col("source")) & (F.col("source") != ""), F.lit(False)).alias("echoes"))


@book.query("path_caps", t.cte("relations", extra="""
p AS (SELECT workspace, id, list_filter(list_transform(string_split(file_path, '<SEP>'), lambda x: trim(x)), lambda x: x <> '') AS l FROM relations WHERE file_path IS NOT NULL)""") + """
SELECT workspace, id, array_to_string(CASE WHEN len(l) > 1 THEN list_concat(list_slice(l, 1, 1), ['...truncated...(KEEP)']) ELSE l END, '<SEP>') AS paths FROM p""")
def path_caps(spark, sf):
    """Paths cut to the first, with a mark where there were more."""
    rows = t.relations(spark, sf).filter("file_path IS NOT NULL").select("workspace", "id", T.split_markers("file_path", [T.SEP]).alias("l"))
    return rows.select("workspace", "id", F.array_join(r.capped_paths(F.col("l"), 1, r.KEEP), "<SEP>").alias("paths"))


@book.query("cached_answers", """
WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS k FROM documents WHERE text IS NOT NULL),
known AS (SELECT DISTINCT k FROM d WHERE doc_id % 2 = 0)
SELECT doc_id, CASE WHEN k IN (SELECT k FROM known) THEN 'cached' ELSE 'asked' END AS answer FROM d""")
def cached_answers(spark, sf):
    """Answers from the cache where equal prompts were asked before, from the model for the others."""
    docs = table(spark, sf, "documents").filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("id"), F.md5("text").alias("prompt"))
    known = docs.filter("CAST(id AS bigint) % 2 = 0").select(T.cache_key(F.lit("default"), F.lit("query"), T.sanitize("prompt")).alias("id"), F.lit("cached").alias("return_value")).distinct()
    answers, _ = sv.cached_calls(docs, known, lambda prompts: ["asked"] * len(prompts), "default", "query")
    return answers.select(F.col("id").cast("bigint").alias("doc_id"), F.col("return_value").alias("answer"))

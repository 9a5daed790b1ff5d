"""Queries on chunks, graphs, resolution, extraction and strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import chunking as ch
from lodestack.operators import extraction as ex
from lodestack.operators import graph as g
from lodestack.operators import maintenance as m
from lodestack.operators import resolve as r
from lodestack.operators import search as s
from lodestack.operators import summaries as sm
from lodestack.plans import tables as t
from lodestack.plans.book import Book
from lodestack.session import table

book = Book()


# Chunks.
def _windows_sql(last: str) -> str:
    return f"""
WITH tokens AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS t FROM documents WHERE text IS NOT NULL),
starts AS (SELECT doc_id, t, unnest(range(0, {last}, 50)) AS start FROM tokens WHERE len(t) > 0)
SELECT doc_id, start // 50 AS chunk_order_index, start, CAST(len(list_slice(t, start + 1, start + 60)) AS BIGINT) AS n_tokens,
  array_to_string(list_slice(t, start + 1, start + 60), ' ') AS content FROM starts"""


@book.query("chunk_windows", _windows_sql("len(t)"))
def chunk_windows(spark, sf):
    """Windows of 60 words that overlap by 10."""
    docs = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", T.words("text").alias("t"))
    return ch.windows(docs, "t", 60, 10)


@book.query("rerank_windows", _windows_sql("greatest(0, len(t) - 11) + 1"))
def rerank_windows(spark, sf):
    """The same windows, but none that lies within the one before."""
    docs = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", T.words("text").alias("t"))
    return ch.windows(docs, "t", 60, 10, stop_at_end=True)


@book.query("chunk_split_sections", t.cte("docs", extra="""
parts AS (SELECT workspace, id, string_split(content, '## ') AS p FROM docs WHERE content IS NOT NULL),
pieces AS (SELECT workspace, id, i, CASE WHEN i = 1 THEN p[i] ELSE '## ' || p[i] END AS content FROM (SELECT workspace, id, p, unnest(range(1, len(p) + 1)) AS i FROM parts))""") + """
SELECT workspace, id, row_number() OVER (PARTITION BY workspace, id ORDER BY i) - 1 AS chunk_order_index, content FROM pieces WHERE regexp_replace(content, '[ \\t\\r\\n]', '', 'g') <> ''""")
def chunk_split_sections(spark, sf):
    """Sections that a heading opens."""
    return ch.sections(t.docs(spark, sf).filter("content IS NOT NULL").select("workspace", "id", "content"), "content", "## ")


@book.query("chunk_page_lookup", """
WITH tokens AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS n FROM documents WHERE text IS NOT NULL),
starts AS (SELECT doc_id, n, unnest(range(0, n, 50)) AS start FROM tokens WHERE n > 0)
SELECT doc_id, start, least(start // 40 + 1, CAST(ceil(n / 40.0) AS BIGINT)) AS page FROM starts""")
def chunk_page_lookup(spark, sf):
    """The page that a window starts on, for pages of 40 words."""
    docs = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", T.words("text").alias("t")).filter(F.size("t") > 0)
    n = F.size("t")
    ends = F.transform(F.sequence(F.lit(40), n + 39, F.lit(40)), lambda e: F.least(e, F.size("t")))
    wins = ch.windows(docs.withColumn("ends", ends), "t", 60, 10)
    return wins.select("doc_id", "start", ch.page_of(F.col("start"), F.col("ends")).cast("bigint").alias("page"))


@book.query("neighbor_chunks", t.cte("chunks", extra="""
anchors AS (SELECT * FROM (SELECT (ascii(right(id, 1)) % 4)::BIGINT AS query_id, workspace, id AS chunk_id, row_number() OVER (PARTITION BY ascii(right(id, 1)) % 4 ORDER BY id, workspace) AS rank FROM chunks) WHERE rank <= 8),
wanted AS (SELECT query_id, a.workspace, full_doc_id, rank, step, chunk_order_index + step AS idx FROM anchors a JOIN chunks c ON c.workspace = a.workspace AND c.id = a.chunk_id, (VALUES (1), (2)) v(step) WHERE rank <= 5),
met AS (SELECT query_id, w.workspace, c.id AS chunk_id, min((rank, step)) AS f FROM wanted w JOIN chunks c ON c.workspace = w.workspace AND c.full_doc_id = w.full_doc_id AND c.chunk_order_index = w.idx GROUP BY 1, 2, 3)""") + """
SELECT query_id, workspace, chunk_id, f[1] AS anchor_rank, f[2]::BIGINT AS step FROM met WHERE (query_id, workspace, chunk_id) NOT IN (SELECT (query_id, workspace, chunk_id) FROM anchors)""")
def neighbor_chunks(spark, sf):
    rows = t.chunks(spark, sf).select("workspace", F.col("id").alias("chunk_id"), "full_doc_id", "chunk_order_index")
    anchors = rows.withColumn("query_id", (F.ascii(F.substring("chunk_id", -1, 1)) % 4).cast("bigint")).select("query_id", "workspace", "chunk_id")
    return ch.neighbours(s.top(anchors, ["query_id"], [F.col("chunk_id"), F.col("workspace")], 8), rows)


@book.query("chunk_enrichment", t.cte("chunks", "docs") + """
SELECT c.workspace, c.id, coalesce(nullif(c.file_path, ''), d.doc_name, 'unknown_source') AS file_path, c.chunk_order_index
FROM chunks c LEFT JOIN docs d ON d.workspace = c.workspace AND d.id = c.full_doc_id""")
def chunk_enrichment(spark, sf):
    """The file of every chunk, from its document where it has none of its own."""
    docs = t.docs(spark, sf).select("workspace", F.col("id").alias("full_doc_id"), "doc_name")
    path = F.coalesce(F.nullif("file_path", F.lit("")), F.col("doc_name"), F.lit("unknown_source"))
    return t.chunks(spark, sf).join(docs, ["workspace", "full_doc_id"], "left").select("workspace", "id", path.alias("file_path"), "chunk_order_index")


# Graphs.
@book.query("node_degree", t.cte("degrees", "nodes") + "SELECT label, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN degrees USING (label)")
def node_degree(spark, sf):
    return g.degrees(t.edges(spark, sf), t.nodes(spark, sf))


@book.query("edge_degree", t.cte("degrees") + """
SELECT src, tgt, a.degree + b.degree AS degree FROM edges JOIN degrees a ON a.label = src JOIN degrees b ON b.label = tgt""")
def edge_degree(spark, sf):
    return g.edge_degrees(t.edges(spark, sf))


@book.query("popular_labels", t.cte("degrees", "nodes") + "SELECT label, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN degrees USING (label) ORDER BY degree DESC, label LIMIT 30")
def popular_labels(spark, sf):
    return g.popular(t.edges(spark, sf), t.nodes(spark, sf), 30)


@book.query("search_labels", t.cte("nodes") + """
SELECT label, CAST(CASE WHEN lower(label) = 'museum' THEN 1000 WHEN starts_with(lower(label), 'museum') THEN 500
  ELSE 100 - length(label) + CASE WHEN contains(lower(label), ' museum') OR contains(lower(label), '_museum') THEN 50 ELSE 0 END END AS BIGINT) AS score
FROM nodes WHERE contains(lower(label), 'museum') ORDER BY score DESC, label LIMIT 20""")
def search_labels(spark, sf):
    return g.search_labels(t.nodes(spark, sf), "museum", 20)


@book.query("has_edges", t.cte("edges", extra="""asked AS (SELECT DISTINCT least(source_id, target_id) AS src, greatest(source_id, target_id) AS tgt FROM ekr_vdb_relation WHERE source_id <> target_id
  UNION SELECT 'Nobody', 'No one')""") + "SELECT a.src, a.tgt, e.weight IS NOT NULL AS there FROM asked a LEFT JOIN edges e USING (src, tgt)")
def has_edges(spark, sf):
    edges = t.edges(spark, sf)
    asked = g.canonical(table(spark, sf, "ekr_vdb_relation").select(F.col("source_id").alias("src"), F.col("target_id").alias("tgt"))).distinct()
    asked = asked.unionByName(spark.createDataFrame([("Nobody", "No one")], "src string, tgt string"))
    return asked.join(edges, ["src", "tgt"], "left").select("src", "tgt", F.col("weight").isNotNull().alias("there"))


@book.query("incident_edges", t.cte("links", "nodes") + """
SELECT label, least(a, b) AS src, greatest(a, b) AS tgt, weight FROM nodes JOIN links ON label = a""")
def incident_edges(spark, sf):
    """The edges of every node, hubs among them."""
    met = g.both_ways(t.edges(spark, sf)).join(t.nodes(spark, sf).withColumnRenamed("label", "src"), "src")
    return met.select(F.col("src").alias("label"), F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), "weight")


@book.query("top_degree_subgraph", t.cte("degrees", extra="best AS (SELECT label FROM degrees ORDER BY degree DESC, label LIMIT 40)") + """
SELECT src, tgt, weight FROM edges WHERE src IN (SELECT label FROM best) AND tgt IN (SELECT label FROM best)""")
def top_degree_subgraph(spark, sf):
    edges = t.edges(spark, sf)
    best = g.degrees(edges).orderBy(F.desc("degree"), "label").limit(40)
    return g.induced(edges, best)


HOPS_SQL = """start AS ((SELECT label FROM degrees ORDER BY degree, label LIMIT 3) UNION (SELECT label FROM degrees ORDER BY degree DESC, label LIMIT 1)),
hops AS (SELECT label, 0 AS depth FROM start UNION SELECT b, 1 FROM links JOIN start ON label = a
  UNION SELECT l2.b, 2 FROM links l1 JOIN start ON label = l1.a JOIN links l2 ON l2.a = l1.b)"""


@book.query("bfs_subgraph", t.cte("degrees", extra=HOPS_SQL) + "SELECT label, min(depth) AS depth FROM hops GROUP BY label")
def bfs_subgraph(spark, sf):
    """All nodes within two hops of three nodes and of the largest hub, with their distance."""
    edges = t.edges(spark, sf)
    d = g.degrees(edges)
    return g.within_hops(edges, d.orderBy("degree", "label").limit(3).unionByName(d.orderBy(F.desc("degree"), "label").limit(1)), 2)


RANK_SQL = """total AS (SELECT a, sum(weight) AS total FROM links GROUP BY 1),
shares AS (SELECT l.a, l.b, l.weight / total AS share FROM links l JOIN total USING (a)),
anchors AS (SELECT label FROM degrees ORDER BY degree DESC, label LIMIT 5),
w AS (SELECT label, CASE WHEN label IN (SELECT label FROM anchors) THEN 10e0 ELSE 1e0 END AS w FROM degrees),
r0 AS (SELECT label, w / (SELECT sum(w) FROM w) AS jump, w / (SELECT sum(w) FROM w) AS rank FROM w)""" + "".join(f""",
r{i} AS (SELECT label, jump, jump * 0.15e0 + 0.85e0 * coalesce(got, 0e0) AS rank FROM r{i - 1} LEFT JOIN
  (SELECT b AS label, sum(rank * share) AS got FROM shares JOIN r{i - 1} ON label = a GROUP BY 1) USING (label))""" for i in range(1, 6))


def _ranks(spark, sf):
    edges = t.edges(spark, sf)
    anchors = g.degrees(edges).orderBy(F.desc("degree"), "label").limit(5)
    return edges, anchors, g.pagerank(edges, 5, anchors)


@book.query("pagerank", t.cte("degrees", extra=RANK_SQL) + "SELECT label, round(rank, 9) AS rank FROM r5")
def pagerank(spark, sf):
    """Five rounds of PageRank that prefers five anchors."""
    return _ranks(spark, sf)[2].select("label", F.round("rank", 9).alias("rank"))


@book.query("pagerank_smart_edges", t.cte("degrees", extra=RANK_SQL) + """
SELECT src, tgt, round((a.rank + b.rank) * CASE WHEN src IN (SELECT label FROM anchors) AND tgt IN (SELECT label FROM anchors) THEN 2e0 ELSE 1e0 END, 9) AS smart_rank
FROM edges JOIN r5 a ON a.label = src JOIN r5 b ON b.label = tgt""")
def pagerank_smart_edges(spark, sf):
    edges, anchors, ranks = _ranks(spark, sf)
    return g.smart_rank(edges, ranks, anchors).select("src", "tgt", F.round("smart_rank", 9).alias("smart_rank"))


# Resolution and merging.
def _node_rows(spark, sf):
    rows = table(spark, sf, "knowledge_graph_node")
    p = F.col("properties")
    kind = F.coalesce(F.nullif(F.trim(p["entity_type"]), F.lit("")), F.lit("UNKNOWN"))
    return rows.select(
        F.col("id").alias("name"), F.lower(kind).alias("type"), p["description"].alias("description"), p["source_id"].alias("source_id"),
        p["file_path"].alias("file_path"), p["created_at"].cast("bigint").alias("ord"),
    )


NODE_ROWS = """node_rows AS (SELECT id AS name, lower(coalesce(nullif(trim(properties['entity_type']), ''), 'UNKNOWN')) AS type, properties['description'] AS description,
  properties['source_id'] AS source_id, properties['file_path'] AS file_path, CAST(properties['created_at'] AS BIGINT) AS ord FROM knowledge_graph_node)"""
KEYED_SQL = """keyed AS (SELECT label AS name, string_agg(CASE WHEN length(w) > 3 THEN regexp_replace(w, '[sx]$', '') ELSE w END, ' ' ORDER BY i) AS key FROM
  (SELECT label, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT label, regexp_split_to_array(replace(lower(label), 'ß', 'ss'), '[ \\t\\r\\n]+') AS ws FROM nodes)) WHERE w <> '' GROUP BY label)"""


@book.query("entity_resolution", t.cte("nodes", extra=NODE_ROWS + ",\n" + KEYED_SQL + """,
firsts AS (SELECT name, min(ord) AS ord FROM node_rows GROUP BY name),
canon AS (SELECT key, arg_min(name, (ord, name)) AS canonical FROM keyed JOIN firsts USING (name) GROUP BY key)""") + "SELECT name, canonical FROM keyed JOIN canon USING (key)")
def entity_resolution(spark, sf):
    """Every node's name with the first name of the same merge key."""
    return r.canonical_names(_node_rows(spark, sf), "name", "ord")


@book.query("type_vote", "WITH " + NODE_ROWS + """
SELECT name, type FROM (SELECT name, type, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, min(ord), type DESC) AS rn FROM node_rows GROUP BY name, type) WHERE rn = 1""")
def type_vote(spark, sf):
    return r.type_votes(_node_rows(spark, sf), "name", "type", "ord")


@book.query("merge_nodes", "WITH " + NODE_ROWS + """,
votes AS (SELECT name, type FROM (SELECT name, type, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, min(ord), type DESC) AS rn FROM node_rows GROUP BY name, type) WHERE rn = 1),
d AS (SELECT name, string_agg(v, '<SEP>' ORDER BY ord, length(v) DESC, v) AS descriptions FROM (SELECT name, description AS v, min(ord) AS ord FROM node_rows WHERE description <> '' GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT name, string_agg(v, '<SEP>' ORDER BY ord, v) AS file_paths FROM (SELECT name, file_path AS v, min(ord) AS ord FROM node_rows WHERE file_path <> '' GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT name, string_agg(v, '<SEP>' ORDER BY ord, v) AS source_ids FROM (SELECT name, source_id AS v, min(ord) AS ord FROM node_rows WHERE source_id <> '' GROUP BY 1, 2) GROUP BY 1)
SELECT name, type, descriptions, source_ids, file_paths FROM votes LEFT JOIN d USING (name) LEFT JOIN f USING (name) LEFT JOIN s USING (name)""")
def merge_nodes(spark, sf):
    merged = r.merge_nodes(_node_rows(spark, sf))
    return merged.select("name", "type", F.col("description").alias("descriptions"), *[F.array_join(c, "<SEP>").alias(c) for c in ("source_ids", "file_paths")])


@book.query("merge_edges", t.cte("relation_rows", extra="""
base AS (SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, sum(weight) AS weight, count(*) AS n_rows FROM (SELECT src AS src, tgt AS tgt, weight FROM relation_rows WHERE src <> tgt) GROUP BY 1, 2),
words AS (SELECT DISTINCT a AS src, b AS tgt, trim(k) AS k FROM (SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, unnest(string_split(coalesce(keywords, ''), ',')) AS k FROM relation_rows WHERE src <> tgt) WHERE trim(k) <> '')""") + """
SELECT src, tgt, weight, n_rows, keywords FROM base LEFT JOIN (SELECT src, tgt, string_agg(k, ',' ORDER BY k) AS keywords FROM words GROUP BY 1, 2) USING (src, tgt)""")
def merge_edges(spark, sf):
    rows = t.relation_rows(spark, sf)
    return r.merge_edges(rows.select("src", "tgt", "weight", "keywords"))


@book.query("missing_endpoints", t.cte("edges", "nodes") + """
SELECT label, 'UNKNOWN' AS type FROM (SELECT src AS label FROM edges UNION SELECT tgt FROM edges) WHERE label NOT IN (SELECT label FROM nodes)""")
def missing_endpoints(spark, sf):
    return r.missing_endpoints(t.edges(spark, sf), t.nodes(spark, sf))


def _sources(spark, sf):
    """src, tgt, workspace, chunk_id and ord of every chunk an edge comes from; ord counts places in a row's list too."""
    rows = g.canonical(t.relation_rows(spark, sf).select("src", "tgt", "ord", "source_ids", "workspace"))
    each = rows.select("src", "tgt", "workspace", "ord", F.posexplode("source_ids").alias("i", "chunk_id")).filter("chunk_id <> ''")
    return each.groupBy("src", "tgt", "workspace", "chunk_id").agg(F.struct(F.min("ord").alias("ord"), F.min("i").alias("i")).alias("ord"))


SOURCE_IDS = """firsts AS (SELECT src, tgt, c, min(ord) AS ord, min(i) AS i FROM (SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, ord, unnest(source_ids) AS c, generate_subscripts(source_ids, 1) AS i
  FROM (SELECT src AS src, tgt AS tgt, ord, source_ids FROM relation_rows WHERE src <> tgt)) WHERE c <> '' GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY ord, i, c) AS n, count(*) OVER (PARTITION BY src, tgt) AS total FROM firsts)"""


def _kept(spark, sf, method):
    each = _sources(spark, sf).groupBy("src", "tgt", "chunk_id").agg(F.struct(F.min("ord.ord"), F.min("ord.i")).alias("ord"))
    kept = m.kept_sources(each, ["src", "tgt"], 2, method)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))), lambda x: x.chunk_id)
    return kept.groupBy("src", "tgt").agg(F.array_join(ids, "<SEP>").alias("source_ids"))


@book.query("source_ids_fifo", t.cte("relation_rows", extra=SOURCE_IDS) + "SELECT src, tgt, string_agg(c, '<SEP>' ORDER BY n) AS source_ids FROM ranked WHERE n > total - 2 GROUP BY 1, 2")
def source_ids_fifo(spark, sf):
    """The last two chunks of every edge."""
    return _kept(spark, sf, r.FIFO)


@book.query("source_ids_keep", t.cte("relation_rows", extra=SOURCE_IDS) + "SELECT src, tgt, string_agg(c, '<SEP>' ORDER BY n) AS source_ids FROM ranked WHERE n <= 2 GROUP BY 1, 2")
def source_ids_keep(spark, sf):
    return _kept(spark, sf, r.KEEP)


@book.query("delete_impact", t.cte("relation_rows", "docs", extra="""
each_source AS (SELECT DISTINCT least(src, tgt) AS src, greatest(src, tgt) AS tgt, workspace, c FROM (SELECT src AS src, tgt AS tgt, workspace, unnest(source_ids) AS c FROM relation_rows WHERE src <> tgt) WHERE c <> ''),
gone AS (SELECT DISTINCT workspace, id AS c FROM ekr_doc_chunks WHERE (workspace, full_doc_id) IN (SELECT (workspace, id) FROM docs WHERE right(id, 1) IN ('0', '1', '2', '3')))""") + """
SELECT src, tgt, CASE WHEN count(g.c) = 0 THEN 'untouched' WHEN count(g.c) = count(*) THEN 'delete' ELSE 'rebuild' END AS impact, count(*) - count(g.c) AS n_remaining
FROM each_source r LEFT JOIN gone g ON g.c = r.c AND g.workspace = r.workspace GROUP BY 1, 2""")
def delete_impact(spark, sf):
    """What deleting a fourth of the documents does to every edge: sources count in their workspace, and nothing is gathered."""
    docs = t.docs(spark, sf).filter(F.substring("id", -1, 1).isin("0", "1", "2", "3")).select("workspace", F.col("id").alias("full_doc_id")).distinct()
    gone = table(spark, sf, "ekr_doc_chunks").join(docs, ["workspace", "full_doc_id"], "left_semi").select("workspace", F.col("id").alias("chunk_id"))
    return m.impact(_sources(spark, sf).select("src", "tgt", "workspace", "chunk_id"), ["src", "tgt"], gone)


@book.query("incremental_chunk_ids", t.cte("status") + """
SELECT workspace, id, array_to_string(list_concat(list_filter(l, lambda x: NOT list_contains(list_slice(l, 1, 1), x)), ['chunk-new']), '<SEP>') AS ids
FROM (SELECT workspace, id, coalesce(chunks_list, []) AS l FROM docs_status)""")
def incremental_chunk_ids(spark, sf):
    """Chunk lists after their first chunk was replaced by a new one."""
    current = F.coalesce("chunks_list", F.array().cast("array<string>"))
    old = F.slice(current, 1, 1)
    return t.status(spark, sf).select("workspace", "id", F.array_join(r.incremental_ids(current, old, F.array(F.lit("chunk-new"))), "<SEP>").alias("ids"))


@book.query("subtract_source_ids", t.cte("relations") + """
SELECT workspace, id, array_to_string(list_filter(chunk_ids, lambda x: x <> '' AND NOT list_contains(list_slice(chunk_ids, 2, 2), x)), '<SEP>') AS ids FROM relations WHERE chunk_ids IS NOT NULL""")
def subtract_source_ids(spark, sf):
    rows = t.relations(spark, sf).filter("chunk_ids IS NOT NULL")
    return rows.select("workspace", "id", F.array_join(r.subtracted_ids(F.col("chunk_ids"), F.slice("chunk_ids", 2, 1)), "<SEP>").alias("ids"))


@book.query("attr_strategies", "WITH " + NODE_ROWS + """,
keyed AS (SELECT type AS k, name, description, ord FROM node_rows)
SELECT k, arg_min(description, (ord, name)) FILTER (WHERE description <> '') AS keep_first, arg_max(description, (ord, name)) FILTER (WHERE description <> '') AS keep_last,
  max(ord::DOUBLE) AS max_ord, count(DISTINCT description) FILTER (WHERE description <> '') AS n_unique FROM keyed GROUP BY k""")
def attr_strategies(spark, sf):
    """Attributes of all nodes of a type merged by several strategies."""
    rows = _node_rows(spark, sf).withColumn("o", F.struct("ord", "name"))
    unique = F.count_distinct(F.nullif("description", F.lit("")))
    return rows.groupBy(F.col("type").alias("k")).agg(
        r.merged_attribute("description", "o", "keep_first").alias("keep_first"), r.merged_attribute("description", "o", "keep_last").alias("keep_last"),
        r.merged_attribute("ord", "o", "max").alias("max_ord"), unique.alias("n_unique"),
    )


@book.query("merge_entities_repoint", t.cte("edges", "nodes", extra=KEYED_SQL + """,
mapping AS (SELECT name AS label, first_value(name) OVER (PARTITION BY split_part(key, ' ', 1) ORDER BY name) AS target FROM keyed),
moved AS (SELECT coalesce(a.target, src) AS s, coalesce(b.target, tgt) AS d, weight FROM edges LEFT JOIN mapping a ON a.label = src LEFT JOIN mapping b ON b.label = tgt)""") + """
SELECT least(s, d) AS src, greatest(s, d) AS tgt, max(weight) AS weight, count(*) AS n_edges FROM moved WHERE s <> d GROUP BY 1, 2""")
def merge_entities_repoint(spark, sf):
    """Edges after all nodes with the same first word were merged into the first of them."""
    keyed = t.nodes(spark, sf).withColumn("key", F.split(T.merge_key("label"), " ")[0])
    target = keyed.groupBy("key").agg(F.min("label").alias("target"))
    return r.repointed(t.edges(spark, sf), keyed.join(target, "key").select("label", "target"))


@book.query("rename_entity", t.cte("degrees", extra="hub AS (SELECT label FROM degrees ORDER BY degree DESC, label LIMIT 1)") + """
SELECT least(s, d) AS src, greatest(s, d) AS tgt, max(weight) AS weight, count(*) AS n_edges FROM
(SELECT CASE WHEN src IN (SELECT label FROM hub) THEN 'Renamed' ELSE src END AS s, CASE WHEN tgt IN (SELECT label FROM hub) THEN 'Renamed' ELSE tgt END AS d, weight FROM edges) GROUP BY 1, 2""")
def rename_entity(spark, sf):
    edges = t.edges(spark, sf)
    hub = g.degrees(edges).orderBy(F.desc("degree"), "label").limit(1).withColumn("target", F.lit("Renamed"))
    return r.repointed(edges, hub)


@book.query("delete_entity", t.cte("degrees", extra="hub AS (SELECT label FROM degrees ORDER BY degree DESC, label LIMIT 1)") + """
SELECT src, tgt, weight FROM edges WHERE src NOT IN (SELECT label FROM hub) AND tgt NOT IN (SELECT label FROM hub)""")
def delete_entity(spark, sf):
    edges = t.edges(spark, sf)
    hub = g.degrees(edges).orderBy(F.desc("degree"), "label").limit(1)
    return m.without_entities(t.nodes(spark, sf), edges, hub)[1]


@book.query("export_edges_both_ways", t.cte("links") + "SELECT a AS src, b AS tgt, weight FROM links")
def export_edges_both_ways(spark, sf):
    return r.export_edges(t.edges(spark, sf))


# Extraction.
RECORDS = """cache AS (SELECT DISTINCT workspace, id, return_value FROM ekr_llm_cache WHERE cache_type = 'extract' AND return_value IS NOT NULL),
lines AS (SELECT workspace, id, return_value, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT workspace, id, return_value, regexp_split_to_array(replace(return_value, '<|COMPLETE|>', ''), '\\r?\\n') AS l FROM cache)),
fields AS (SELECT workspace, id, row_number() OVER (PARTITION BY workspace, id, return_value ORDER BY i) AS i, list_transform(string_split(line, '<|#|>'), lambda x: trim(x)) AS f FROM lines WHERE trim(line) <> '')"""


def _parsed(spark, sf):
    cache = table(spark, sf, "ekr_llm_cache").filter("cache_type = 'extract' AND return_value IS NOT NULL").select("workspace", "id", "return_value").distinct()
    return ex.records(cache, "return_value", ["workspace", "id"])


@book.query("parse_entities", "WITH " + RECORDS + """
SELECT workspace, id, f[2] AS name, replace(lower(f[3]), ' ', '') AS type, f[4] AS description FROM fields
WHERE len(f) = 4 AND contains(lower(f[1]), 'entity') AND f[2] <> '' AND f[3] <> '' AND f[4] <> '' AND NOT regexp_matches(f[3], '[''"()<>|/\\\\]')""")
def parse_entities(spark, sf):
    return ex.entities(_parsed(spark, sf), ["workspace", "id"]).drop("pos")


@book.query("parse_relations", "WITH " + RECORDS + """
SELECT workspace, id, f[2] AS src, f[3] AS tgt, replace(f[4], '，', ',') AS keywords, f[5] AS description,
  CASE WHEN regexp_matches(f[5], '^[-+]?[0-9]*\\.?[0-9]+$') THEN f[5]::DOUBLE ELSE 1e0 END AS weight FROM fields
WHERE len(f) = 5 AND contains(lower(f[1]), 'relation') AND f[2] <> '' AND f[3] <> '' AND f[2] <> f[3]""")
def parse_relations(spark, sf):
    return ex.relations(_parsed(spark, sf), ["workspace", "id"]).drop("pos")


# Ways to spoil a delimiter: a part lost, doubled or written wrongly.
SPOILT = (
    "<|#|>", "<|##|>", "<|#||#|>", "<|#|||#|>", "<|\\#|>", "<|>", "<||>", "<X|#|>", "<|#|Y>", "<X|#|Y>", "<||#||>", "<#>", "<#|>", "<|#>", "<X#|>", "<|#X>",
    "<|#|", "<|#||", "<|#:", "<||#>", "<||", "|#|>", "<|#|>|", "||#||", "<| # |>",
)


@book.query("fix_delimiters", """
WITH bad AS (SELECT DISTINCT workspace, id, i, line FROM (SELECT workspace, id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM
  (SELECT DISTINCT workspace, id, string_split(return_value, chr(10)) AS l FROM ekr_llm_cache WHERE cache_type = 'extract' AND return_value IS NOT NULL)) WHERE contains(line, '<|#|>'))
SELECT workspace, id, i::BIGINT AS pos, 'a <> b < c > ' || line AS fixed FROM bad""")
def fix_delimiters(spark, sf):
    """Delimiters that were spoilt in several ways, put right again."""
    cache = table(spark, sf, "ekr_llm_cache").filter("cache_type = 'extract' AND return_value IS NOT NULL").select("workspace", "id", "return_value").distinct()
    lines = cache.select("workspace", "id", F.posexplode(F.split("return_value", "\n")).alias("pos", "line")).filter(F.contains("line", F.lit("<|#|>")))
    ways = F.array(*[F.lit(x) for x in SPOILT])
    spoilt = F.concat(F.lit("a <> b < c > "), F.replace("line", F.lit("<|#|>"), F.get(ways, F.col("pos") % len(SPOILT))))
    return lines.select("workspace", "id", (F.col("pos") + 1).cast("bigint").alias("pos"), T.repaired_delimiters(spoilt).alias("fixed"))


@book.query("gleaning_merge", "WITH " + RECORDS + """,
ents AS (SELECT workspace, f[2] AS name, f[4] AS description, i FROM fields WHERE len(f) = 4 AND contains(lower(f[1]), 'entity') AND f[2] <> '' AND f[4] <> '' AND NOT regexp_matches(f[3], '[''"()<>|/\\\\]') AND f[3] <> ''),
a AS (SELECT workspace, name, max(description) AS d1 FROM ents WHERE i % 2 = 1 GROUP BY 1, 2), b AS (SELECT workspace, name, max(description) AS d2 FROM ents WHERE i % 2 = 0 GROUP BY 1, 2)
SELECT workspace, name, CASE WHEN length(d2) > length(d1) THEN d2 ELSE coalesce(d1, d2) END AS description FROM a FULL JOIN b USING (workspace, name)""")
def gleaning_merge(spark, sf):
    """Records of two passes (here of odd and even lines), the longer description each."""
    rows = ex.entities(_parsed(spark, sf), ["workspace", "id"])
    passes = [rows.filter(F.col("pos") % 2 == i).groupBy("workspace", "name").agg(F.max("description").alias("description")) for i in (0, 1)]
    return ex.gleaned(*passes, ["workspace", "name"])


@book.query("cached_extractions", """
WITH refs AS (SELECT DISTINCT workspace, id AS chunk_id FROM ekr_doc_chunks),
cache AS (SELECT workspace, chunk_id, id AS cache_id, min(create_time) AS create_time FROM ekr_llm_cache WHERE cache_type = 'extract' GROUP BY 1, 2, 3)
SELECT workspace, chunk_id, cache_id, row_number() OVER (PARTITION BY workspace, chunk_id ORDER BY create_time, cache_id) AS rank FROM refs JOIN cache USING (workspace, chunk_id)""")
def cached_extractions(spark, sf):
    cache = table(spark, sf, "ekr_llm_cache").groupBy("workspace", "id", "cache_type", "chunk_id").agg(F.min("create_time").alias("create_time"))
    return ex.cached_extractions(table(spark, sf, "ekr_doc_chunks"), cache)


@book.query("summary_branch", t.cte("relations", extra="""
parts AS (SELECT source_id AS name, list(DISTINCT content ORDER BY content) AS d FROM relations WHERE source_id IS NOT NULL AND content IS NOT NULL GROUP BY 1),
sized AS (SELECT name, d, list_sum(list_transform(d, lambda x: length(x)::DOUBLE / 4)) AS tokens FROM parts)""") + """
SELECT name, tokens, CASE WHEN len(d) = 1 THEN 'single' WHEN len(d) < 8 AND tokens < 300 THEN 'joined' ELSE 'model' END AS plan,
  CASE WHEN len(d) = 1 OR (len(d) < 8 AND tokens < 300) THEN array_to_string(d, '<SEP>') END AS summary FROM sized""")
def summary_branch(spark, sf):
    """Which entities' descriptions need a model to become one; only few and short ones are gathered."""
    rows = t.relations(spark, sf).filter("source_id IS NOT NULL AND content IS NOT NULL").select(F.col("source_id").alias("name"), F.col("content").alias("description"))
    return sm.summary_plan(rows, 300, 8)

"""Queries on keyed tables, keys and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import keyvalue as kv
from lodestack.plans import tables as t
from lodestack.plans.book import Book
from lodestack.session import table

book = Book()


@book.query("doc_ids_dedupe", """
SELECT 'doc-' || md5(text) AS id, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY text""")
def doc_ids_dedupe(spark, sf):
    """Content-addressed ids, one row a distinct content."""
    docs = table(spark, sf, "documents").filter("text IS NOT NULL")
    return docs.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies")).select(T.content_id("doc", "text").alias("id"), "doc_id", "n_copies")


@book.query("enqueue_filter", """
WITH clean AS (SELECT doc_id, replace(replace(replace(replace(replace(regexp_replace(text, '[\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{7F}-\\x{9F}\\x{FFFE}\\x{FFFF}]', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS c FROM documents),
content AS (SELECT doc_id, regexp_replace(c, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS content FROM clean),
first AS (SELECT content, min(doc_id) AS doc_id FROM content WHERE content <> '' GROUP BY content)
SELECT 'doc-' || md5(content) AS id, doc_id, 'pending' AS status FROM first
WHERE 'doc-' || md5(content) NOT IN (SELECT 'doc-' || md5(text) FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL)""")
def enqueue_filter(spark, sf):
    """Documents to queue: cleaned, the first of equal contents, without those already stored (here every fifth)."""
    docs = table(spark, sf, "documents")
    known = docs.filter("doc_id % 5 = 0 AND text IS NOT NULL").select(T.content_id("doc", "text").alias("id"))
    return kv.enqueue(docs, known, "text", "doc_id").select("id", "doc_id", F.lit("pending").alias("status"))


@book.query("kv_upsert", t.cte("status", extra="""
old AS (SELECT * FROM docs_status WHERE updated_at < TIMESTAMP '2024-07-01'),
new AS (SELECT workspace, id, 'processed' AS status, chunks_count FROM docs_status WHERE updated_at >= TIMESTAMP '2024-04-01')""") + """
SELECT workspace, id, status, chunks_count FROM new
UNION ALL SELECT workspace, id, status, chunks_count FROM old WHERE (workspace, id) NOT IN (SELECT (workspace, id) FROM new)""")
def kv_upsert(spark, sf):
    rows = t.status(spark, sf)
    old = rows.filter("updated_at < TIMESTAMP_NTZ '2024-07-01'").select("workspace", "id", "status", "chunks_count")
    new = rows.filter("updated_at >= TIMESTAMP_NTZ '2024-04-01'").select("workspace", "id", F.lit("processed").alias("status"), "chunks_count")
    return kv.upsert(old, new, ["workspace", "id"])


@book.query("kv_overlay", t.cte("status", extra="""
old AS (SELECT id, workspace, status, error_msg FROM docs_status WHERE updated_at < TIMESTAMP '2024-07-01'),
new AS (SELECT id, workspace, CAST(NULL AS VARCHAR) AS status, 'seen' AS error_msg FROM docs_status WHERE chunks_count > 3)""") + """
SELECT workspace, id, coalesce(n.status, o.status) AS status, coalesce(n.error_msg, o.error_msg) AS error_msg
FROM old o FULL OUTER JOIN new n USING (workspace, id)""")
def kv_overlay(spark, sf):
    """Attribute merge: new values laid over old ones, column by column."""
    rows = t.status(spark, sf)
    old = rows.filter("updated_at < TIMESTAMP_NTZ '2024-07-01'").select("workspace", "id", "status", "error_msg")
    new = rows.filter("chunks_count > 3").select("workspace", "id", F.lit(None).cast("string").alias("status"), F.lit("seen").alias("error_msg"))
    return kv.overlay(old, new, ["workspace", "id"])


@book.query("delete_by_ids", t.cte("chunks") + """
SELECT workspace, id FROM chunks WHERE (workspace, id) NOT IN (SELECT (workspace, id) FROM chunks WHERE tokens IS NULL OR tokens < 50)""")
def delete_by_ids(spark, sf):
    rows = t.chunks(spark, sf)
    return kv.delete_keys(rows.select("workspace", "id"), rows.filter("tokens IS NULL OR tokens < 50"), ["workspace", "id"])


@book.query("get_by_ids_ordered", t.cte("status", "docs") + """
SELECT s.workspace, s.id AS status_id, pos, w.id, d.doc_name, length(d.content) AS n_chars FROM
(SELECT workspace, id, unnest(l) AS wid, generate_subscripts(l, 1) AS pos FROM (SELECT workspace, id, [id, 'doc-none', id] AS l FROM docs_status)) s
JOIN (SELECT 1) ON TRUE LEFT JOIN docs d ON d.workspace = s.workspace AND d.id = s.wid, LATERAL (SELECT s.wid AS id) w""")
def get_by_ids_ordered(spark, sf):
    """For the request of every status row, its document, one that isn't there and again its document, in this order."""
    ids = F.array(F.col("id"), F.lit("doc-none"), F.col("id"))
    wanted = t.status(spark, sf).select("workspace", F.col("id").alias("status_id"), F.posexplode(ids).alias("pos", "id")).withColumn("pos", F.col("pos").cast("bigint") + 1)
    docs = t.docs(spark, sf).select("workspace", "id", "doc_name", F.length("content").alias("n_chars"))
    return wanted.join(docs, ["workspace", "id"], "left").select("workspace", "status_id", "pos", "id", "doc_name", "n_chars")


@book.query("filter_keys", """
SELECT DISTINCT c AS id FROM (SELECT unnest(chunk_ids) AS c FROM ekr_vdb_relation) WHERE c <> '' AND c NOT IN (SELECT id FROM ekr_doc_chunks)""")
def filter_keys(spark, sf):
    """Which of all chunk ids that relations name are missing."""
    asked = table(spark, sf, "ekr_vdb_relation").select(F.explode("chunk_ids").alias("id")).filter("id <> ''")
    return kv.missing_keys(asked, table(spark, sf, "ekr_doc_chunks"), "id")


@book.query("status_counts", t.cte("status", extra="known(status) AS (VALUES ('pending'), ('processing'), ('preprocessed'), ('processed'), ('failed'))") + """
SELECT k.status, count(s.id) AS n_docs FROM known k LEFT JOIN docs_status s USING (status) GROUP BY k.status""")
def status_counts(spark, sf):
    return kv.status_counts(t.status(spark, sf))


@book.query("status_rollup", t.cte("status") + """
SELECT CASE WHEN grouping(status) = 1 THEN 'all' ELSE status END AS status, count(*) AS n_docs FROM docs_status GROUP BY ROLLUP (status)""")
def status_rollup(spark, sf):
    return kv.status_rollup(t.status(spark, sf))


@book.query("docs_paginated", t.cte("status") + """
SELECT id, workspace, status, updated_at FROM docs_status ORDER BY updated_at DESC, id, workspace LIMIT 25 OFFSET 25""")
def docs_paginated(spark, sf):
    rows = t.status(spark, sf).select("id", "workspace", "status", "updated_at")
    return kv.page(rows, "updated_at", 2, 25, ["updated_at", "created_at", "id"], ["id", "workspace"])


@book.query("docs_by_status", t.cte("status") + """
SELECT workspace, id, status, track_id FROM docs_status WHERE status IN ('processing', 'failed', 'pending')""")
def docs_by_status(spark, sf):
    """The queue of the next run: running, failed and pending documents."""
    return t.status(spark, sf).filter(F.col("status").isin("processing", "failed", "pending")).select("workspace", "id", "status", "track_id")


@book.query("docs_by_path", t.cte("status") + """
SELECT file_path, id FROM (SELECT file_path, id, row_number() OVER (PARTITION BY file_path ORDER BY created_at, id) AS rn
FROM docs_status WHERE file_path IS NOT NULL) WHERE rn = 1""")
def docs_by_path(spark, sf):
    rows = t.status(spark, sf).filter("file_path IS NOT NULL")
    return kv.latest(rows, ["file_path"], [F.col("created_at"), F.col("id")]).select("file_path", "id")


@book.query("status_consistency", t.cte("status", "docs") + """
SELECT s.workspace, s.id, CASE WHEN s.status IN ('processing', 'failed') THEN 'pending' ELSE s.status END AS status
FROM docs_status s LEFT JOIN (SELECT DISTINCT workspace, id, TRUE AS there FROM docs) d USING (workspace, id) WHERE there OR s.status = 'failed'""")
def status_consistency(spark, sf):
    return kv.consistent(t.status(spark, sf), t.docs(spark, sf), ["workspace", "id"]).select("workspace", "id", "status")


@book.query("full_doc_chunks", t.cte("chunks") + """
SELECT workspace, full_doc_id, count(*) AS n_chunks, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(length(content)) AS BIGINT) AS n_chars
FROM chunks WHERE full_doc_id IS NOT NULL GROUP BY ALL""")
def full_doc_chunks(spark, sf):
    """Counters of every document from its chunks."""
    return t.chunks(spark, sf).filter("full_doc_id IS NOT NULL").groupBy("workspace", "full_doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("tokens").alias("tokens"), F.sum(F.length("content")).alias("n_chars"))


@book.query("content_summary", """
SELECT doc_id, CASE WHEN length(trim(text)) > 250 THEN substr(trim(text), 1, 250) || '...' ELSE trim(text) END AS summary FROM documents""")
def content_summary(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.summary("text").alias("summary"))


@book.query("word_counts", """
SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM
(SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents) GROUP BY term""")
def word_counts(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(T.words("text")).alias("term"))
    per_doc = rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@book.query("merge_keys", t.cte("nodes") + """
SELECT label, coalesce(string_agg(CASE WHEN length(w) > 3 THEN regexp_replace(w, '[sx]$', '') ELSE w END, ' ' ORDER BY i), '') AS merge_key
FROM (SELECT label, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT label, regexp_split_to_array(replace(lower(label), 'ß', 'ss'), '[ \\t\\r\\n]+') AS ws FROM nodes))
WHERE w <> '' GROUP BY label""")
def merge_keys(spark, sf):
    return t.nodes(spark, sf).select("label", T.merge_key("label").alias("merge_key"))


@book.query("cache_key_parts", """
SELECT workspace, id, split_part(id, ':', 1) AS mode, split_part(id, ':', 2) AS type, split_part(id, ':', 3) AS hash
FROM ekr_llm_cache WHERE length(id) - length(replace(id, ':', '')) >= 2 GROUP BY ALL""")
def cache_key_parts(spark, sf):
    rows = table(spark, sf, "ekr_llm_cache").select("workspace", "id").distinct()
    return rows.select("workspace", "id", T.cache_key_parts("id").alias("p")).filter("p IS NOT NULL").select("workspace", "id", "p.mode", "p.type", "p.hash")


@book.query("cache_lookup", """
WITH calls AS (SELECT DISTINCT workspace, chunk_id FROM ekr_llm_cache WHERE chunk_id IS NOT NULL),
asked AS (SELECT DISTINCT workspace, id AS chunk_id FROM ekr_doc_chunks)
SELECT workspace, count(*) AS n_chunks, count(*) FILTER (WHERE c.hit) AS n_hits
FROM asked LEFT JOIN (SELECT workspace, chunk_id, TRUE AS hit FROM calls) c USING (workspace, chunk_id) GROUP BY workspace""")
def cache_lookup(spark, sf):
    """Chunks whose call is in the cache already, and those that would need a model."""
    calls = table(spark, sf, "ekr_llm_cache").filter("chunk_id IS NOT NULL").select("workspace", "chunk_id").distinct().withColumn("hit", F.lit(True))
    asked = table(spark, sf, "ekr_doc_chunks").select("workspace", F.col("id").alias("chunk_id")).distinct()
    return asked.join(calls, ["workspace", "chunk_id"], "left").groupBy("workspace").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if("hit").alias("n_hits"))


@book.query("split_paths", t.cte("relations") + """
SELECT workspace, id, pos, path FROM (SELECT workspace, id, unnest(p) AS path, generate_subscripts(p, 1) AS pos
FROM (SELECT workspace, id, list_filter(list_transform(string_split(file_path, '<SEP>'), lambda x: trim(x)), lambda x: x <> '') AS p FROM relations))""")
def split_paths(spark, sf):
    rows = t.relations(spark, sf).select("workspace", "id", F.posexplode(T.split_markers("file_path", [T.SEP])).alias("pos", "path"))
    return rows.select("workspace", "id", (F.col("pos") + 1).cast("bigint").alias("pos"), "path")


@book.query("text_scalars", """
SELECT doc_id, regexp_matches(trim(split_part(text, ' ', 1)), '^[-+]?[0-9]*\\.?[0-9]+$') AS starts_with_number,
  regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') AS has_cjk, CASE WHEN coalesce(source, '') = '' THEN text ELSE source || chr(10) || text END AS headed,
  substr(text, 1, 256) AS identifier, length(text)::DOUBLE / 4 AS estimated_tokens FROM documents WHERE text IS NOT NULL""")
def text_scalars(spark, sf):
    docs = table(spark, sf, "documents").filter("text IS NOT NULL")
    return docs.select(
        "doc_id", T.is_number(F.trim(F.split_part("text", F.lit(" "), F.lit(1)))).alias("starts_with_number"), T.has_cjk("text").alias("has_cjk"),
        T.headed("source", "text").alias("headed"), T.identifier("text").alias("identifier"), T.estimated_tokens("text").alias("estimated_tokens"),
    )


@book.query("pair_keys", t.cte("relation_rows") + "SELECT DISTINCT least(src, tgt) || '<SEP>' || greatest(src, tgt) AS pair_key FROM relation_rows")
def pair_keys(spark, sf):
    return t.relation_rows(spark, sf).select(T.pair_key("src", "tgt").alias("pair_key")).distinct()

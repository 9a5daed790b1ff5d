"""Queries of the streaming operators, on tables: what a stream of the same rows ends with."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.plans.book import Book
from lodestack.session import scratch, table
from lodestack.sources.catalog import Catalog
from lodestack.streaming import ingest

book = Book()


@book.query("events_tumbling", """
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def events_tumbling(spark, sf):
    return ingest.tumbling(table(spark, sf, "events")).withColumn("value", F.round("value", 4))


@book.query("events_session", """
WITH marked AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events),
numbered AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS value FROM numbered GROUP BY user_id, s""")
def events_session(spark, sf):
    return ingest.sessions(table(spark, sf, "events")).withColumn("value", F.round("value", 4))


@book.query("stream_ingest", """
WITH clean AS (SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(regexp_replace(text, '[\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{7F}-\\x{9F}\\x{FFFE}\\x{FFFF}]', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS content FROM documents),
docs AS (SELECT DISTINCT content FROM clean WHERE content <> '')
SELECT 'doc-' || md5(content) AS id, 'processed' AS status, length(content)::INTEGER AS content_length,
  CAST(ceil(len(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+')) / 50.0) AS BIGINT) AS chunks_count FROM docs""")
def stream_ingest(spark, sf):
    """Documents ingested as a stream: the status table it ends with."""
    root = scratch(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    catalog = Catalog(spark, root)
    query = ingest.ingest_stream(spark, f"{sf}/documents.parquet*", docs.schema, catalog, f"{root}/checkpoint")
    query.awaitTermination()
    return catalog.read_latest("doc_status", ["id"]).select("id", "status", "content_length", "chunks_count")

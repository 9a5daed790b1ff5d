"""Incremental ingestion and event windows with Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.text import content_id, sanitize, summary, words
from lodestack.operators.chunking import windows
from lodestack.operators.keyvalue import latest
from lodestack.session import cut, reachable
from lodestack.sources.catalog import Catalog


class Cancelled(RuntimeError):
    """The run was asked to stop."""


def window_chunks(docs: DataFrame, size: int = 60, overlap: int = 10) -> DataFrame:
    """Chunks (full_doc_id, chunk_order_index, start, n_tokens, content, error) of documents (id, content)."""
    return windows(docs.select(F.col("id").alias("full_doc_id"), words("content").alias("t")), "t", size, overlap).withColumn("error", F.lit(None).cast("string"))


def own_chunks(chunker: Callable[[str], list]) -> Callable[[DataFrame], DataFrame]:
    """Chunks by a function of a content that gives a list of texts or of objects with tokens, content and chunk_order_index.

    A document for which it fails or gives something else has an error in place of chunks.
    """

    def of(content: str) -> list[tuple]:
        got = chunker(content)
        if not isinstance(got, (list, tuple)):
            raise TypeError(f"a chunker must give a list, this gave {type(got).__name__}")
        out = []
        for i, c in enumerate(got):
            c = c if isinstance(c, dict) else {"content": str(c)}
            out.append((int(c.get("chunk_order_index", i)), int(c.get("tokens", len(c["content"].split()))), c["content"]))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc, content in zip(rows["id"], rows["content"]):
                try:
                    out += [(doc, i, None, n, text, None) for i, n, text in of(content)]
                except Exception as e:
                    out.append((doc, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["full_doc_id", "chunk_order_index", "start", "n_tokens", "content", "error"])

    def chunks(docs: DataFrame) -> DataFrame:
        reachable(docs.sparkSession)
        return docs.select("id", "content").mapInPandas(run, "full_doc_id string, chunk_order_index bigint, start bigint, n_tokens bigint, content string, error string")

    return chunks


def _status(docs: DataFrame, status: str, seq: int, **more) -> DataFrame:
    own = {"content_length": F.length("content"), "content_summary": summary("content"), "chunks_count": F.lit(0).cast("bigint"), "error": F.lit(None).cast("string"), **more}
    return docs.select("id", F.lit(status).alias("status"), *[c.alias(k) for k, c in own.items()], F.lit(seq).cast("bigint").alias("seq"))


def enqueue(catalog: Catalog, batch: DataFrame) -> None:
    """Documents (doc_id, text) that aren't known yet are stored with status pending; equal contents count once."""
    rows = batch.select(F.col("doc_id"), sanitize("text").alias("content")).filter("content <> ''")
    rows = latest(rows, ["content"], [F.col("doc_id")]).withColumn("id", content_id("doc", "content"))
    version = catalog.version()
    known = catalog.read("full_docs")
    if known is not None:
        rows = rows.join(known.select("id"), "id", "left_anti")
    rows = cut(rows.select("id", "doc_id", "content"))
    if not rows.isEmpty():
        catalog.append({"full_docs": rows, "doc_status": _status(rows, "pending", 10 * (version + 1))}, version)


def enqueue_errors(catalog: Catalog, errors: DataFrame) -> None:
    """Documents that could not be read (path, error), as rows of status failed."""
    version = catalog.version()
    rows = errors.select(
        F.concat(F.lit("error-"), F.md5(F.concat_ws("-", "path", "error"))).alias("id"), F.lit("failed").alias("status"), F.lit(0).alias("content_length"), F.col("path").alias("content_summary"),
        F.lit(0).cast("bigint").alias("chunks_count"), "error", F.lit(10 * (version + 1)).cast("bigint").alias("seq"),
    ).dropDuplicates(["id"])
    catalog.append({"doc_status": rows}, version)


def process(catalog: Catalog, chunker: Callable[[DataFrame], DataFrame] = window_chunks) -> int:
    """Chunk all documents that are pending, processing (a run was lost) or failed; how many there were.

    They are first marked as processing. Chunks and final states are committed at once;
    only rows of this run are written. A document whose chunker fails becomes failed with
    the error and is tried again by the next run.
    """
    status, docs = catalog.read_latest("doc_status", ["id"]), catalog.read("full_docs")
    if status is None or docs is None:
        return 0
    todo = cut(docs.join(status.filter(F.col("status").isin("pending", "processing", "failed")).select("id"), "id", "left_semi"))
    n = todo.count()
    if not n:
        return 0
    version = catalog.append({"doc_status": _status(todo, "processing", 10 * (catalog.version() + 1))})
    catalog.say(json.dumps({"processing": n}))
    if catalog.flagged("cancel"):
        catalog.append({"doc_status": _status(todo, "failed", 10 * (version + 1), error=F.lit("cancelled"))}, version)
        catalog.say(json.dumps({"cancelled": n}))
        raise Cancelled(f"{n} documents were left")
    made = cut(chunker(todo))
    counts = made.groupBy(F.col("full_doc_id").alias("id")).agg(F.count_if(F.col("error").isNull()).alias("n"), F.max("error").alias("error"))
    done = todo.join(counts.withColumnRenamed("error", "__error"), "id", "left")
    failed = F.col("__error").isNotNull()
    final = _status(done, "", 10 * (version + 1), chunks_count=F.when(failed, 0).otherwise(F.coalesce("n", F.lit(0))).cast("bigint"), error=F.col("__error"))
    final = final.withColumn("status", F.when(F.col("error").isNotNull(), "failed").otherwise("processed"))
    good = made.join(counts.filter("error IS NULL").select(F.col("id").alias("full_doc_id")), "full_doc_id", "left_semi").drop("error")
    chunks = good.withColumn("id", content_id("chunk", F.concat_ws("|", "full_doc_id", "chunk_order_index")))
    catalog.append({"text_chunks": chunks, "doc_status": final}, version)
    catalog.say(json.dumps({"done": n}))
    return n


def ingest_batch(catalog: Catalog, batch: DataFrame, chunker: Callable[[DataFrame], DataFrame] = window_chunks) -> None:
    """Store the new documents of a batch and process all that wait; known ones change nothing."""
    enqueue(catalog, batch)
    process(catalog, chunker)


def ingest_stream(spark: SparkSession, source: str, schema, catalog: Catalog, checkpoint: str, chunker: Callable[[DataFrame], DataFrame] = window_chunks):
    """Process every new Parquet file of a folder once; a restart goes on from the checkpoint, repeats change nothing."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return (
        stream.writeStream.foreachBatch(lambda batch, _: ingest_batch(catalog, batch, chunker)).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their sum per window and type; works on tables and on streams, where late ones are dropped."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    counted = rows.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    counted = rows.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return counted.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "value")

"""Changes of a knowledge base: delete and rebuild from cached extractions, edits, merges, tracking tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.operators import extraction as ex
from lodestack.operators.graph import canonical
from lodestack.operators.resolve import FIFO, described, first_values, merged_attribute
from lodestack.session import cut


@dataclass
class Records:
    """Extracted records: entities (name, type, description, chunk_id, file_path, ord) and relations (src, tgt, weight, keywords, description, chunk_id, file_path, ord)."""

    entities: DataFrame
    relations: DataFrame


def extracted(cache: DataFrame, chunks: DataFrame) -> Records:
    """The records of the cached extractions (chunk_id, return_value, ord) of the chunks (chunk_id, file_path).

    A record of an entity that a chunk's calls repeat counts once, with its longest
    description, the oldest of equals.
    """
    calls = cache.filter("return_value IS NOT NULL").join(chunks.select("chunk_id", "file_path"), "chunk_id")
    parsed = cut(ex.records(calls, "return_value", ["chunk_id", "file_path", "ord"]))
    keep = ["chunk_id", "file_path", "ord"]

    def longest(rows: DataFrame, keys: list[str]) -> DataFrame:
        first = F.row_number().over(W.partitionBy(*keys, "chunk_id").orderBy(F.length("description").desc(), "ord", "pos", "description"))
        return rows.withColumn("n", first).filter("n = 1").drop("n", "pos")

    pairs = canonical(ex.relations(parsed, keep))
    return Records(longest(ex.entities(parsed, keep), ["name"]), longest(pairs, ["src", "tgt"]))


def built(records: Records, most: int = 300, method: str = FIFO) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of records: types by vote, descriptions listed, weights summed, keywords united, sources and paths capped."""
    e, r = records.entities, records.relations
    votes = e.groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    nodes = votes.groupBy("name").agg(F.max_by("type", F.struct("n", -F.col("first"), "type")).alias("type"))
    for part in (described(e, ["name"], most), first_values(e, ["name"], "chunk_id", most, method), first_values(e, ["name"], "file_path", most, method)):
        nodes = nodes.join(part, "name", "left")
    pair = ["src", "tgt"]
    edges = r.groupBy(*pair).agg(F.sum("weight").alias("weight"))
    words = r.select(*pair, F.explode(F.split(F.coalesce("keywords", F.lit("")), ",")).alias("k")).select(*pair, F.trim("k").alias("k")).filter("k <> ''").distinct()
    united = words.groupBy(*pair).agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("keywords"))
    for part in (united, described(r, pair, most), first_values(r, pair, "chunk_id", most, method), first_values(r, pair, "file_path", most, method)):
        edges = edges.join(part, pair, "left")
    return nodes, edges


def with_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and those that only edges name, of type UNKNOWN."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("name")).distinct().join(nodes.select("name"), "name", "left_anti")
    return nodes.unionByName(ends.withColumn("type", F.lit("UNKNOWN")), allowMissingColumns=True)


def impact(sources: DataFrame, keys: list[str], gone: DataFrame) -> DataFrame:
    """keys, impact (delete, rebuild, untouched) and n_remaining of items whose sources (keys, chunk_id) lose the chunks of gone.

    Nothing is gathered: sources and losses are counted. gone may have further columns of
    sources, such as workspace, which then count too.
    """
    on = [c for c in gone.columns if c in sources.columns]
    met = sources.join(gone.select(*on).distinct().withColumn("__g", F.lit(1)), on, "left")
    counts = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("__g").alias("k"))
    kind = F.when(F.col("k") == 0, "untouched").when(F.col("k") == F.col("n"), "delete").otherwise("rebuild")
    return counts.select(*keys, kind.alias("impact"), (F.col("n") - F.col("k")).alias("n_remaining"))


def rebuilt_after_delete(records: Records, nodes: DataFrame, edges: DataFrame, gone: DataFrame, most: int = 300, method: str = FIFO) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the chunks of gone (chunk_id) were deleted.

    Items that lose all chunks go, those that lose some are made anew from the records of
    the chunks that stay, the others remain as they are. Only records of affected items are
    read again.
    """
    g = cut(gone.select("chunk_id").distinct())
    of_nodes = cut(impact(records.entities.select("name", "chunk_id").distinct(), ["name"], g))
    of_edges = cut(impact(records.relations.select("src", "tgt", "chunk_id").distinct(), ["src", "tgt"], g))
    again = Records(
        records.entities.join(of_nodes.filter("impact = 'rebuild'").select("name"), "name", "left_semi").join(g, "chunk_id", "left_anti"),
        records.relations.join(of_edges.filter("impact = 'rebuild'").select("src", "tgt"), ["src", "tgt"], "left_semi").join(g, "chunk_id", "left_anti"),
    )
    new_nodes, new_edges = built(again, most, method)
    out_nodes = nodes.join(of_nodes.filter("impact <> 'untouched'").select("name"), "name", "left_anti").unionByName(new_nodes, allowMissingColumns=True)
    out_edges = edges.join(of_edges.filter("impact <> 'untouched'").select("src", "tgt"), ["src", "tgt"], "left_anti").unionByName(new_edges, allowMissingColumns=True)
    return out_nodes, out_edges


def delete_documents(tables: dict[str, DataFrame], documents: DataFrame, records: Records, with_cache: bool = False, most: int = 300) -> dict[str, DataFrame | None]:
    """All tables of a knowledge base after documents (workspace, id) were deleted, to be committed at once.

    tables are full_docs, doc_status, text_chunks (id, full_doc_id), nodes, edges and
    llm_response_cache (id, chunk_id); vectors of chunks, entities and relations go with what
    they belong to.
    """
    key = ["workspace", "id"]
    gone_docs = documents.select(*key).distinct()
    gone = cut(tables["text_chunks"].join(gone_docs.withColumnRenamed("id", "full_doc_id"), ["workspace", "full_doc_id"], "left_semi").select("workspace", F.col("id").alias("chunk_id")))
    nodes, edges = rebuilt_after_delete(records, tables["nodes"], tables["edges"], gone, most)
    out: dict[str, DataFrame | None] = {
        "full_docs": tables["full_docs"].join(gone_docs, key, "left_anti"), "doc_status": tables["doc_status"].join(gone_docs, key, "left_anti"),
        "text_chunks": tables["text_chunks"].join(gone.withColumnRenamed("chunk_id", "id"), key, "left_anti"), "nodes": nodes, "edges": edges,
    }
    if with_cache and "llm_response_cache" in tables:
        out["llm_response_cache"] = tables["llm_response_cache"].join(gone, ["workspace", "chunk_id"], "left_anti")
    for name, left in (("vdb_chunks", out["text_chunks"].select("workspace", "id")), ("vdb_entities", nodes.select("name")), ("vdb_relationships", edges.select("src", "tgt"))):
        if name in tables:
            out[name] = tables[name].join(left, left.columns, "left_semi")
    return out


def document_index(chunks: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """workspace, full_doc_id and keys: which entities or relations (keys, workspace, chunk_id) each document has."""
    return chunks.select("workspace", F.col("id").alias("chunk_id"), "full_doc_id").filter("full_doc_id <> ''").join(sources, ["workspace", "chunk_id"]).select("workspace", "full_doc_id", *keys).distinct()


def tracking(sources: DataFrame, keys: list[str]) -> DataFrame:
    """keys, chunk_id and position: the tracking table as rows, in order of first appearance."""
    each = sources.filter("chunk_id <> ''").groupBy(*keys, "chunk_id").agg(F.min("ord").alias("ord"))
    return each.select(*keys, "chunk_id", F.row_number().over(W.partitionBy(*keys).orderBy("ord", "chunk_id")).cast("bigint").alias("pos"))


def backfilled(present: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """A tracking table with the rows of the items it lacks."""
    lacking = sources.join(present.select(*keys).distinct(), keys, "left_anti")
    return present.unionByName(tracking(lacking, keys).select(*present.columns))


def new_version(documents: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of incoming documents (workspace, id, file_path): the stored ones they replace, and those to be stored.

    A document with the path of a stored one replaces it unless its content, and so its id,
    is the same.
    """
    same = incoming.join(documents.select("workspace", "id"), ["workspace", "id"], "left_anti")
    old = documents.filter("file_path IS NOT NULL").join(same.select("workspace", "file_path").distinct(), ["workspace", "file_path"], "left_semi").select("workspace", "id")
    return old, same


# Edits.
def without_entities(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the entities of gone (label)."""
    g = gone.select("label").distinct()
    left = edges.join(g.withColumnRenamed("label", "src"), "src", "left_anti").join(g.withColumnRenamed("label", "tgt"), "tgt", "left_anti")
    return nodes.join(g, "label", "left_anti"), left


def without_relations(edges: DataFrame, gone: DataFrame) -> DataFrame:
    pair = gone.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).distinct()
    return edges.join(pair, ["src", "tgt"], "left_anti")


def edited(df: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the values that changes has for their key; null means no change."""
    rest = [c for c in changes.columns if c not in keys]
    x = df.join(changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in rest]), keys, "left")
    return x.select(*[F.coalesce(f"__{c}", c).alias(c) if c in rest else c for c in df.columns])


def renamed_entities(nodes: DataFrame, edges: DataFrame, names: DataFrame, allow_merge: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with entities renamed (label, target). A name that exists already is an error, or merges with allow_merge."""
    if not allow_merge:
        taken = names.join(nodes.select(F.col("label").alias("target")), "target", "left_semi").orderBy("target").first()
        if taken:
            raise ValueError(f"there is an entity {taken['target']} already")
    return merged_entities(nodes, edges, names)


def merged_entities(nodes: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after entities (label) were merged into others (target).

    Descriptions are joined in order of label with the target's own first, types and paths
    kept as first; edges are pointed anew, loops dropped, parallel ones joined: the largest
    weight, keywords and sources united.
    """
    m = mapping.select("label", "target")
    named = nodes.join(m, "label", "left").withColumn("name", F.coalesce("target", "label"))
    named = named.withColumn("o", F.struct((F.col("label") != F.col("name")).alias("other"), F.col("label").alias("label")))
    out = named.groupBy(F.col("name").alias("label")).agg(
        merged_attribute("type", "o", "keep_first").alias("type"), merged_attribute("description", "o", "concatenate").alias("description"),
        merged_attribute("source_id", "o", "join_unique").alias("source_id"),
    )
    x = edges.join(m.select(F.col("label").alias("src"), F.col("target").alias("s")), "src", "left").join(m.select(F.col("label").alias("tgt"), F.col("target").alias("t")), "tgt", "left")
    moved = canonical(x.withColumn("src", F.coalesce("s", "src")).withColumn("tgt", F.coalesce("t", "tgt")).drop("s", "t"))
    moved = moved.withColumn("o", F.struct("src", "tgt", "description"))
    return out, moved.groupBy("src", "tgt").agg(
        F.max("weight").alias("weight"), merged_attribute("description", "o", "concatenate").alias("description"),
        merged_attribute("keywords", "o", "join_unique_comma").alias("keywords"), merged_attribute("source_id", "o", "join_unique").alias("source_id"),
    )


def created_entities(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes with new ones; one that is there already is an error."""
    there = new.join(nodes.select("label"), "label", "left_semi").orderBy("label").first()
    if there:
        raise ValueError(f"there is an entity {there['label']} already")
    return nodes.unionByName(new.select(*nodes.columns))


def created_relations(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with new ones; one that is there already or lacks an end is an error."""
    rows = canonical(new)
    there = rows.join(edges.select("src", "tgt"), ["src", "tgt"], "left_semi").orderBy("src", "tgt").first()
    if there:
        raise ValueError(f"there is a relation of {there['src']} and {there['tgt']} already")
    ends = rows.select(F.explode(F.array("src", "tgt")).alias("label")).distinct().join(nodes.select("label"), "label", "left_anti").orderBy("label").first()
    if ends:
        raise ValueError(f"there is no entity {ends['label']}")
    return edges.unionByName(rows.select(*edges.columns))


def without_vectors_of(vectors: DataFrame, gone: DataFrame) -> DataFrame:
    """Vectors of relations (src, tgt) without those at an entity of gone (label)."""
    g = gone.select("label").distinct()
    return vectors.join(g.withColumnRenamed("label", "src"), "src", "left_anti").join(g.withColumnRenamed("label", "tgt"), "tgt", "left_anti")


def within_kept_sources(rows: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, chunk_id) of the chunks that the cap keeps (keys, chunk_id)."""
    return rows.join(kept.select(*keys, "chunk_id").distinct(), [*keys, "chunk_id"], "left_semi")


def kept_sources(rows: DataFrame, keys: Sequence[str], most: int, method: str = FIFO) -> DataFrame:
    """keys and chunk_id of the last (FIFO) or first `most` chunks of each item, ranked before anything is gathered."""
    each = rows.filter("chunk_id <> ''").groupBy(*keys, "chunk_id").agg(F.min("ord").alias("ord"))
    order = [F.col("ord").desc(), F.col("chunk_id").desc()] if method == FIFO else [F.col("ord"), F.col("chunk_id")]
    return each.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("n") <= most).select(*keys, "chunk_id", "ord")



"""Retrieval strategies over batches of queries: plans composed of the search and graph operators.

Every strategy takes a Store, queries (query_id, query: their vectors) and options, and gives
entities, relations and chunks as ranked rows of each query. Hits are lists of top-k results,
so they are small beside the tables; they are written once, since several stages read them.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.functions.text import SEP
from lodestack.functions.vectors import cosine
from lodestack.operators import chunking as ch
from lodestack.operators import context as cx
from lodestack.operators import graph as g
from lodestack.operators import search as s
from lodestack.session import cut, cut_all

DAMPING, ANCHOR = 0.85, 10.0


@dataclass
class Store:
    """The tables a strategy reads.

    entity_vectors (label, embedding), relation_vectors (src, tgt, embedding), chunk_vectors
    (chunk_id, embedding), nodes (label, type, description), edges (src, tgt, weight,
    description), chunks (chunk_id, content, file_path, full_doc_id, chunk_order_index, and
    where known page_start, heading), entity_chunks (label, chunk_id, ord), relation_chunks
    (src, tgt, chunk_id, ord).
    """

    entity_vectors: DataFrame
    relation_vectors: DataFrame
    chunk_vectors: DataFrame
    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    entity_chunks: DataFrame
    relation_chunks: DataFrame


@dataclass
class Options:
    """What a strategy takes and gives at most."""

    top_k: int = 40
    chunk_top_k: int = 20
    entity_tokens: float = 6000
    relation_tokens: float = 8000
    total_tokens: float = 30_000
    max_related: int = 5
    pick: str = "VECTOR"
    threshold: float | None = None
    # Score of a question and a content for reranking, such as search.overlap_score; None for no reranking.
    rerank: Callable[[str, str], Column] | None = None
    # Vectors of chunks that have none: takes (chunk_id, content), gives (chunk_id, embedding).
    embed: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Found:
    """What a strategy found: entities, relations and chunks, each with query_id and rank."""

    entities: DataFrame | None = None
    relations: DataFrame | None = None
    chunks: DataFrame | None = None


def renumbered(df: DataFrame, *order: Column) -> DataFrame:
    """Ranks from 1 without gaps a query."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*(order or ("rank",)))).cast("bigint"))


def dense_entities(store: Store, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    return s.dense(store.entity_vectors, queries, "label", "embedding", k, threshold)


def dense_relations(store: Store, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    return s.dense(store.relation_vectors, queries, ["src", "tgt"], "embedding", k, threshold)


def dense_chunks(store: Store, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    return s.dense(store.chunk_vectors, queries, "chunk_id", "embedding", k, threshold)


def with_nodes(store: Store, hits: DataFrame) -> DataFrame:
    """Hit entities with their node and degree, in order; hits without a node are dropped."""
    touched = store.edges.select(F.explode(F.array("src", "tgt")).alias("label")).join(hits.select("label").distinct(), "label", "left_semi")
    degree = touched.groupBy("label").agg(F.count(F.lit(1)).alias("degree"))
    rows = hits.select("query_id", "label", "rank").join(store.nodes, "label").join(degree, "label", "left").fillna(0, ["degree"])
    return renumbered(rows).select("query_id", "label", "rank", "degree", "type", "description")


def with_edges(store: Store, hits: DataFrame) -> DataFrame:
    """Hit relations with their edge, in order, weight 1 where it has none; hits without an edge are dropped."""
    pair = hits.select("query_id", F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), "rank")
    return renumbered(pair.join(store.edges, ["src", "tgt"]).fillna(1.0, ["weight"])).select("query_id", "src", "tgt", "rank", "weight", "description")


def endpoint_nodes(store: Store, relations: DataFrame) -> DataFrame:
    """The nodes at the ends of relations, in order of first appearance."""
    ends = relations.select("query_id", "rank", F.posexplode(F.array("src", "tgt")).alias("side", "label"))
    first = ends.groupBy("query_id", "label").agg(F.min(F.struct("rank", "side")).alias("at"))
    rows = first.join(store.nodes, "label")
    return renumbered(rows, F.col("at.rank"), F.col("at.side")).select("query_id", "label", "rank", "type", "description")


def incident_edges(store: Store, entities: DataFrame) -> DataFrame:
    """query_id, anchor, other, weight and description of every edge of the entities, once from each entity."""
    return entities.select("query_id", F.col("label").alias("src"), F.col("rank").alias("hit_rank")).join(g.both_ways(store.edges).fillna(1.0, ["weight"]), "src").select(
        "query_id", F.col("src").alias("anchor"), F.col("tgt").alias("other"), "hit_rank", F.col("weight").cast("double").alias("weight"), "description"
    )


def anchor_ranks(entities: DataFrame, met: DataFrame) -> DataFrame:
    """query_id, label, rank, weight and jump: PageRank of the anchors on each query's graph of anchors and their neighbours.

    The jump prefers anchors ANCHOR to 1. Other nodes have no edges but to anchors, so their
    ranks can be put into the anchors' equations: what is left is one linear system of the
    anchors a query, solved exactly. Neighbours, of which a hub has any number, are only
    summed over. met has query_id, anchor, other, weight, to_anchor. Anchors without edges
    jump anywhere.
    """
    outer = met.filter("NOT to_anchor")
    around = outer.groupBy("query_id", "other").agg(F.sum("weight").alias("all"), F.collect_list(F.struct("anchor", "weight")).alias("own"))
    per_query = around.groupBy("query_id").agg(F.count(F.lit(1)).alias("value"))
    # A neighbour has at most as many anchors as there are hits.
    one = around.select("query_id", "own", "all", F.explode("own").alias("to"))
    # No pairs of neighbours are made, only pairs of the few anchors of each.
    via = one.select("query_id", F.explode("own").alias("from"), "to", "all").groupBy("query_id", F.col("from.anchor").alias("a"), F.col("to.anchor").alias("b")).agg(
        F.sum(F.col("from.weight") * F.col("to.weight") / F.col("all")).alias("value")
    )
    const = one.groupBy("query_id", F.col("to.anchor").alias("a")).agg(F.sum(F.col("to.weight") / F.col("all")).alias("value"))
    direct = met.filter("to_anchor").select("query_id", F.col("anchor").alias("a"), F.col("other").alias("b"), F.col("weight").alias("value"))
    weights = met.groupBy("query_id", F.col("anchor").alias("a")).agg(F.sum("weight").alias("value"))
    null = F.lit(None).cast("string")

    def part(kind: str, df: DataFrame) -> DataFrame:
        have = df.columns
        return df.select(
            "query_id", F.lit(kind).alias("kind"), (F.col("a") if "a" in have else null).alias("a"), (F.col("b") if "b" in have else null).alias("b"),
            (F.col("value") if "value" in have else F.lit(0)).cast("double").alias("value"),
        )

    rows = part("hit", entities.select("query_id", F.col("label").alias("a")))
    for kind, df in (("others", per_query), ("via", via), ("const", const), ("direct", direct), ("weight", weights)):
        rows = rows.unionByName(part(kind, df))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        kinds = dict(tuple(group.groupby("kind")))
        labels = sorted(kinds["hit"]["a"].unique()) if "hit" in kinds else []
        at = {a: i for i, a in enumerate(labels)}
        n = len(labels)
        others = float(kinds["others"]["value"].sum()) if "others" in kinds else 0.0
        total, const, m = np.zeros(n), np.zeros(n), np.zeros((n, n))
        for a, v in zip(*(kinds["weight"][c] for c in ("a", "value"))) if "weight" in kinds else ():
            total[at[a]] = v
        for a, v in zip(*(kinds["const"][c] for c in ("a", "value"))) if "const" in kinds else ():
            const[at[a]] = v
        for kind, factor in (("direct", DAMPING), ("via", DAMPING * DAMPING)):
            if kind in kinds:
                part = kinds[kind]
                np.add.at(m, ([at[b] for b in part["b"]], [at[a] for a in part["a"]]), factor * part["value"].to_numpy())
        size = ANCHOR * n + others
        dangling = ANCHOR * (total == 0).sum() / size
        jump = (1 - DAMPING) + DAMPING * (1 - DAMPING) * dangling / (1 - DAMPING * dangling)
        m = m / np.where(total > 0, total, 1.0)
        rank = np.linalg.solve(np.eye(n) - m, jump * (ANCHOR + DAMPING * const) / size)
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "label": labels, "rank": rank, "weight": total, "jump": jump / size})

    return rows.groupBy("query_id").applyInPandas(solve, "query_id bigint, label string, rank double, weight double, jump double")


def smart_edges(store: Store, entities: DataFrame) -> DataFrame:
    """query_id, src, tgt, rank, smart_rank, weight, description: the entities' edges, most central ends first.

    smart_rank is the sum of the ends' PageRank, doubled between two of the entities.
    """
    anchors = entities.select("query_id", F.col("label").alias("other")).withColumn("to_anchor", F.lit(True))
    met = cut(incident_edges(store, entities).join(anchors, ["query_id", "other"], "left").fillna(False, ["to_anchor"]))
    ranks = cut(anchor_ranks(entities, met))
    own = met.join(ranks.select("query_id", F.col("label").alias("anchor"), F.col("rank").alias("ra"), F.col("weight").alias("wa"), "jump"), ["query_id", "anchor"])
    outer = own.filter("NOT to_anchor").groupBy("query_id", "other").agg((F.max("jump") + DAMPING * F.sum(F.col("ra") * F.col("weight") / F.col("wa"))).alias("ro"))
    inner = ranks.select("query_id", F.col("label").alias("other"), F.col("rank").alias("ri"))
    scored = own.join(outer, ["query_id", "other"], "left").join(inner, ["query_id", "other"], "left").withColumn(
        "smart_rank", F.when(F.col("to_anchor"), 2 * (F.col("ra") + F.col("ri"))).otherwise(F.col("ra") + F.col("ro"))
    )
    once = scored.groupBy("query_id", F.least("anchor", "other").alias("src"), F.greatest("anchor", "other").alias("tgt")).agg(
        F.max("smart_rank").alias("smart_rank"), F.min("hit_rank").alias("hit_rank"), F.max("weight").alias("weight"), F.max("description").alias("description")
    )
    return renumbered(once, F.round("smart_rank", 9).desc(), F.col("hit_rank"), F.col("src"), F.col("tgt")).select(
        "query_id", "src", "tgt", "rank", "smart_rank", "weight", "description"
    )


ENTITY, RELATION = ("label", "type", "description"), ("src", "tgt", "weight", "description")


def local(store: Store, queries: DataFrame, o: Options) -> Found:
    """Entities by vector with their nodes, and their edges by smart rank."""
    entities = cut(with_nodes(store, dense_entities(store, queries, o.top_k, o.threshold)))
    return Found(entities, cut(smart_edges(store, entities)))


def global_(store: Store, queries: DataFrame, o: Options) -> Found:
    """Relations by vector with their edges, then their end nodes."""
    relations = cut(with_edges(store, dense_relations(store, queries, o.top_k, o.threshold)))
    return Found(cut(endpoint_nodes(store, relations)), relations)


def hybrid(store: Store, queries: DataFrame, o: Options) -> Found:
    """Local and global results in turn, local first; the first appearance counts."""
    with ThreadPoolExecutor(2) as pool:
        a, b = pool.map(lambda plan: plan(store, queries, o), (local, global_))
    pair = F.concat_ws(SEP, "src", "tgt").alias("key")
    entities = s.round_robin([x.entities.select("query_id", F.col("label").alias("key"), "rank") for x in (a, b)], "key")
    relations = s.round_robin([x.relations.select("query_id", pair, "rank") for x in (a, b)], "key")
    entities = entities.select("query_id", F.col("key").alias("label"), F.col("position").alias("rank")).join(store.nodes, "label")
    ends = F.split("key", r"\Q" + SEP + r"\E")
    relations = relations.select("query_id", ends[0].alias("src"), ends[1].alias("tgt"), F.col("position").alias("rank")).join(store.edges, ["src", "tgt"]).fillna(1.0, ["weight"])
    return Found(*cut_all(entities.select("query_id", "label", "rank", "type", "description"), relations.select("query_id", "src", "tgt", "rank", "weight", "description")))


def json_line(**fields: str) -> Column:
    """An object of strings as JSON with a blank after commas and colons, by which budgets are counted."""
    text = lambda c: F.regexp_extract(F.to_json(F.array(F.coalesce(F.col(c), F.lit("UNKNOWN")))), r"(?s)^\[(.*)\]$", 1)
    parts = [p for i, (name, c) in enumerate(fields.items()) for p in (F.lit(f"{', ' if i else ''}\"{name}\": "), text(c))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def within_budgets(found: Found, o: Options) -> Found:
    """The first entities and relations whose lines fit the budgets."""
    e = found.entities.withColumn("line", json_line(entity="label", type="type", description="description"))
    r = found.relations.withColumn("line", json_line(entity1="src", entity2="tgt", description="description"))
    e = s.within_budget(e, ["query_id"], ["rank"], "line", o.entity_tokens).drop("line", "used")
    r = s.within_budget(r, ["query_id"], ["rank"], "line", o.relation_tokens).drop("line", "used")
    return Found(*cut_all(e, r), found.chunks)


def related_chunks(items: DataFrame, keys: list[str], sources: DataFrame) -> DataFrame:
    """query_id, chunk_id, item_rank, pos, frequency and n_items of the items' chunks.

    Each chunk is kept at the first item that has it; frequency is the number of items that
    do, n_items that of the items that have any.
    """
    met = items.select("query_id", "rank", *keys).join(sources, keys).select("query_id", "rank", "chunk_id", "ord").filter("chunk_id <> ''").distinct()
    n_items = met.groupBy("query_id").agg(F.countDistinct("rank").alias("n_items"))
    first = met.groupBy("query_id", "chunk_id").agg(F.count_distinct("rank").alias("frequency"), F.min(F.struct("rank", "ord")).alias("at"))
    return first.join(n_items, "query_id").select("query_id", "chunk_id", F.col("at.rank").alias("item_rank"), F.col("at.ord").alias("pos"), "frequency", "n_items")


def picked_by_weight(related: DataFrame, most: int) -> DataFrame:
    """At most `most` chunks a query: in the items' order, of an item first those that most items share."""
    order = [F.col("item_rank"), F.col("frequency").desc(), F.col("pos"), F.col("chunk_id")]
    return s.top(related, ["query_id"], order, most).select("query_id", "chunk_id", "rank", "frequency")


def picked_by_vector(related: DataFrame, store: Store, queries: DataFrame, o: Options) -> DataFrame:
    """The floor of max_related / 2 chunks an item that are most similar to the query, by their stored vectors.

    Chunks without a vector are embedded if there is something to embed with, else left out;
    vectors of another length are too.
    """
    vectors = store.chunk_vectors.select("chunk_id", "embedding")
    if o.embed is not None:
        lacking = related.select("chunk_id").distinct().join(vectors.select("chunk_id"), "chunk_id", "left_anti")
        vectors = vectors.unionByName(o.embed(lacking.join(store.chunks.select("chunk_id", "content"), "chunk_id")).select("chunk_id", "embedding"))
    met = related.join(vectors, "chunk_id").join(F.broadcast(queries.select("query_id", "query").limit(s.MOST_QUERIES)), "query_id").filter(F.size("embedding") == F.size("query"))
    met = met.withColumn("score", F.round(cosine(F.col("embedding"), F.col("query")), 12)).filter("score IS NOT NULL")
    ranked = renumbered(met, F.col("score").desc(), F.col("chunk_id"))
    return ranked.filter(F.col("rank") <= F.floor(F.col("n_items") * o.max_related / 2)).select("query_id", "chunk_id", "rank", "frequency")


def picked(related: DataFrame, store: Store, queries: DataFrame, o: Options) -> DataFrame:
    """Chunks by vector; queries for which that gives none, or all without VECTOR, get them by weight."""
    by_weight = picked_by_weight(related, o.max_related)
    if o.pick.upper() != "VECTOR":
        return by_weight
    by_vector = cut(picked_by_vector(related, store, queries, o))
    return by_vector.unionByName(by_weight.join(by_vector.select("query_id").distinct(), "query_id", "left_anti"))


def graph_chunks(found: Found, store: Store, queries: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """Chunks of the entities, and of the relations without those of the entities."""
    of_entities = picked(cut(related_chunks(found.entities, ["label"], store.entity_chunks)), store, queries, o)
    sources = found.relations.select("query_id", "rank", "src", "tgt").join(store.relation_chunks, ["src", "tgt"]).join(
        of_entities.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti"
    )
    met = sources.select("query_id", "rank", "src", "tgt", "chunk_id", "ord")
    related = related_chunks(met.select("query_id", "rank").distinct(), ["query_id", "rank"], met.select("query_id", "rank", "chunk_id", "ord"))
    return of_entities, picked(cut(related), store, queries, o)


def merged_chunks(store: Store, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """query_id, chunk_id, rank, and where from: source (C, E or R), frequency and order, of ranked lists in turn."""
    lists = [x.join(store.chunks.select("chunk_id"), "chunk_id", "left_semi") for _, x in sources]
    lists = cut_all(*[renumbered(x).withColumn("tag", F.lit(tag)).select("query_id", "chunk_id", "rank", "tag", "frequency") for (tag, _), x in zip(sources, lists)])
    merged = s.round_robin([x.withColumnRenamed("chunk_id", "key") for x in lists], "key").select("query_id", F.col("key").alias("chunk_id"), F.col("position").alias("rank"))
    union = lists[0]
    for x in lists[1:]:
        union = union.unionByName(x)
    # As in a table that every list writes to in turn, the last list that has a chunk names its source.
    turn = F.lit(0)
    for i, (tag, _) in enumerate(sources):
        turn = F.when(F.col("tag") == tag, i).otherwise(turn)
    last = union.withColumn("turn", turn).groupBy("query_id", "chunk_id").agg(F.max_by(F.struct("tag", "frequency", F.col("rank").alias("order")), "turn").alias("t"))
    return merged.join(last, ["query_id", "chunk_id"]).select("query_id", "chunk_id", "rank", F.col("t.tag").alias("source"), "t.frequency", "t.order")


def with_neighbours(store: Store, chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """The chunks and at the end those that follow the first anchors in their documents, with source N."""
    at = store.chunks.select("chunk_id", "full_doc_id", "chunk_order_index")
    met = ch.neighbours(anchors.select("query_id", "chunk_id", "rank"), at, workspaces=False)
    new = met.join(chunks.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    many = chunks.groupBy("query_id").agg(F.max("rank").alias("before"))
    order = F.row_number().over(W.partitionBy("query_id").orderBy("anchor_rank", "step", "chunk_id")).cast("bigint")
    new = new.withColumn("n", order).join(many, "query_id").withColumn("rank", F.col("n") + F.col("before"))
    return chunks.unionByName(new.select("query_id", "chunk_id", "rank", F.lit("N").alias("source"), F.lit(1).cast("bigint").alias("frequency"), F.col("rank").alias("order")))


def reranked_chunks(store: Store, chunks: DataFrame, questions: DataFrame, o: Options) -> DataFrame:
    """The chunk_top_k best chunks by the reranker; unscored ones, all if it fails to score any, keep their order at the tail."""
    have = [c for c in ("heading",) if c in store.chunks.columns]
    rows = chunks.join(store.chunks.select("chunk_id", "content", *have), "chunk_id").join(questions, "query_id")
    if have:
        rows = rows.withColumn("content", F.concat_ws("\n", F.nullif("heading", F.lit("")), "content"))
    best = s.reranked(rows.drop(*have), o.rerank("question", "content"), o.chunk_top_k)
    return best.select("query_id", "chunk_id", "rank", "source", "frequency", "order")


def _one(tag: str, hits: DataFrame) -> tuple[str, DataFrame]:
    return tag, hits.select("query_id", "chunk_id", "rank").withColumn("frequency", F.lit(1).cast("bigint"))


def naive(store: Store, queries: DataFrame, o: Options, questions: DataFrame | None = None) -> Found:
    """Chunks by vector; with a reranker twice as many, reranked down to chunk_top_k."""
    hits = dense_chunks(store, queries, o.chunk_top_k * (2 if o.rerank else 1), o.threshold)
    chunks = merged_chunks(store, [_one("C", cut(hits))])
    return Found(chunks=reranked_chunks(store, cut(chunks), questions, o) if o.rerank else chunks)


def _graph(plan: Callable, vector_hits: Callable | None) -> Callable:
    """A strategy over the graph: its entities and relations within budgets, and their chunks merged with those found by vector."""

    def strategy(store: Store, queries: DataFrame, o: Options, questions: DataFrame | None = None, terms: DataFrame | None = None) -> Found:
        with ThreadPoolExecutor(1) as pool:
            hits = None if vector_hits is None else pool.submit(lambda: cut(vector_hits(store, queries, o, terms)))
            found = within_budgets(plan(store, queries, o), o)
            of_entities, of_relations = graph_chunks(found, store, queries, o)
            first = None if hits is None else hits.result()
        sources = [("E", of_entities), ("R", of_relations)]
        if first is not None:
            sources.insert(0, _one("C", first))
        chunks = merged_chunks(store, sources)
        if o.rerank:
            chunks = cut(chunks)
            if first is not None:
                chunks = with_neighbours(store, chunks, first)
            chunks = reranked_chunks(store, chunks, questions, o)
        return Found(found.entities, found.relations, cut(chunks))

    return strategy


def fused_chunks(store: Store, queries: DataFrame, o: Options, terms: DataFrame | None) -> DataFrame:
    """Chunks by the fused ranks of dense and sparse search; the sparse one reads heading and content."""
    dense = dense_chunks(store, queries, o.chunk_top_k, o.threshold)
    if terms is None:
        raise ValueError("hybrid_mix needs the words of the questions")
    text = F.concat_ws(" ", "heading", "content") if "heading" in store.chunks.columns else F.col("content")
    sparse = s.bm25(store.chunks.select("chunk_id", text.alias("content")), terms, "chunk_id", "content", o.chunk_top_k)
    return s.rrf([dense, sparse], "chunk_id", o.chunk_top_k)


STRATEGIES: dict[str, Callable] = {
    "naive": lambda store, queries, o, questions=None, terms=None: naive(store, queries, o, questions),
    "local": _graph(local, None),
    "global": _graph(global_, None),
    "hybrid": _graph(hybrid, None),
    "mix": _graph(hybrid, lambda store, queries, o, terms: dense_chunks(store, queries, o.chunk_top_k, o.threshold)),
    "hybrid_mix": _graph(hybrid, fused_chunks),
    "bypass": lambda store, queries, o, questions=None, terms=None: Found(),
}
MODES = tuple(STRATEGIES)


def strategy(mode: str) -> Callable:
    """The strategy of a mode."""
    if mode not in STRATEGIES:
        raise ValueError(f"unknown mode {mode}; there are {', '.join(MODES)}")
    return STRATEGIES[mode]


def cited_chunks(store: Store, chunks: DataFrame, budget: float | Column) -> tuple[DataFrame, DataFrame]:
    """The chunks whose contents fit the budget, with content, file and reference_id, and the list of files."""
    have = [c for c in ("page_start", "heading") if c in store.chunks.columns]
    rows = chunks.join(store.chunks.select("chunk_id", "content", "file_path", *have), "chunk_id")
    fit = cut(s.within_budget(rows, ["query_id"], ["rank"], "content", budget))
    refs = s.references(fit.filter("file_path <> 'unknown_source'"), "file_path", "rank").select("query_id", "file_path", "reference_id")
    return fit.join(refs, ["query_id", "file_path"], "left"), refs


def contexts(found: Found, store: Store, o: Options) -> DataFrame:
    """query_id and context: entities, relations, chunks and references as tagged text.

    Chunks get what the entities and relations leave of total_tokens, less 200.
    """
    out = None
    spent = None
    for name, df, line in (
        ("Entities", found.entities, lambda: cx.entity_line("label", "type", "description")), ("Relations", found.relations, lambda: cx.relation_line("src", "tgt", "description")),
    ):
        if df is not None:
            text = cx.rendered(df.withColumn("line", line()), "line", "rank", name.lower())
            out = text if out is None else out.join(text, "query_id", "full_outer")
    chunks = found.chunks
    if chunks is not None:
        if out is not None:
            out = cut(out)
            spent = out.select("query_id", sum((F.coalesce(F.length(c), F.lit(0)) for c in out.columns if c != "query_id"), F.lit(0)).alias("spent"))
            chunks = chunks.join(spent, "query_id", "left").fillna(0, ["spent"])
            budget = F.lit(o.total_tokens - 200) - F.col("spent") / 4
        else:
            budget = o.total_tokens - 200
        fit, refs = cited_chunks(store, chunks, budget)
        fit = fit.withColumn("reference_id", F.coalesce(F.col("reference_id").cast("string"), F.lit("")))
        block = cx.chunk_block("reference_id", "content", "page_start" if "page_start" in fit.columns else None, "heading" if "heading" in fit.columns else None)
        blocks = cx.rendered(fit.withColumn("line", block), "line", "rank", "chunks", between="\n\n")
        listed = cx.rendered(refs.withColumn("line", cx.reference_line("reference_id", "file_path")), "line", "reference_id", "references")
        text = blocks.join(listed, "query_id", "left")
        out = text if out is None else out.join(text, "query_id", "full_outer")
    if out is None:
        raise ValueError("nothing was searched")
    parts = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{c.capitalize()}:\n"), c)) for c in out.columns if c != "query_id"]
    return out.select("query_id", F.concat_ws("\n\n", *parts).alias("context"))

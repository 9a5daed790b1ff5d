"""Undirected graphs: degrees, label search, subgraphs, breadth-first search, PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.skew import hot_hashes, lookup_join
from lodestack.session import cut


def canonical(edges: DataFrame, a: str = "src", b: str = "tgt") -> DataFrame:
    """Edges with src < tgt, without loops and null ends; other columns stay."""
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("tgt"), *rest)


def both_ways(edges: DataFrame) -> DataFrame:
    """Each undirected edge from either end."""
    rest = [c for c in edges.columns if c not in ("src", "tgt")]
    ends = F.array(F.struct(F.col("src").alias("a"), F.col("tgt").alias("b")), F.struct(F.col("tgt").alias("a"), F.col("src").alias("b")))
    return edges.select(F.explode(ends).alias("e"), *rest).select(F.col("e.a").alias("src"), F.col("e.b").alias("tgt"), *rest)


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """label and degree; nodes without edges have 0. Ends are counted without pairing them first."""
    counted = edges.select(F.explode(F.array("src", "tgt")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("degree"))
    return counted if nodes is None else nodes.select("label").join(counted, "label", "left").fillna(0, ["degree"])


def edge_degrees(edges: DataFrame) -> DataFrame:
    """src, tgt and the sum of both ends' degrees."""
    d = degrees(edges)
    return (
        edges.select("src", "tgt").join(d.select(F.col("label").alias("src"), F.col("degree").alias("ds")), "src")
        .join(d.select(F.col("label").alias("tgt"), F.col("degree").alias("dt")), "tgt")
        .select("src", "tgt", (F.col("ds") + F.col("dt")).alias("degree"))
    )


def popular(edges: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    return degrees(edges, nodes).orderBy(F.desc("degree"), "label").limit(n)


def search_labels(nodes: DataFrame, query: str, n: int) -> DataFrame:
    """Labels that hold the query: equal 1000, prefix 500, else 100 less the length, 50 more at a word's start."""
    low, q = F.lower("label"), query.lower().strip()
    boundary = F.contains(low, F.lit(f" {q}")) | F.contains(low, F.lit(f"_{q}"))
    score = F.when(low == q, 1000).when(F.startswith(low, F.lit(q)), 500).otherwise(100 - F.length("label") + F.when(boundary, 50).otherwise(0))
    return nodes.filter(F.contains(low, F.lit(q))).select("label", score.cast("bigint").alias("score")).orderBy(F.desc("score"), "label").limit(n)


def induced(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with both ends among the labels."""
    return edges.join(labels.select(F.col("label").alias("src")), "src", "left_semi").join(labels.select(F.col("label").alias("tgt")), "tgt", "left_semi")


def within_hops(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """label and depth of all nodes within a number of hops of the start labels.

    Each round joins the frontier with the edges and drops what was seen; lineage is cut
    after every round. The edges of hubs stay where they are.
    """
    links = cut(both_ways(edges.select("src", "tgt")))
    hot = hot_hashes(links, ["src"])
    seen = cut(start.select("label").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, hops + 1):
        at = frontier.select(F.col("label").alias("src"), F.lit(True).alias("__at"))
        reached = lookup_join(links, at, ["src"], hot=hot).filter("__at").select(F.col("tgt").alias("label")).distinct()
        frontier = cut(reached.join(seen, "label", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def bounded_search(edges: DataFrame, start: str, hops: int, most: int) -> DataFrame:
    """label, depth and degree of at most `most` nodes, visited level by level, high degrees first, ties by label.

    A level that exceeds what is left is cut before the next is searched from it, so that
    the frontier never holds more than `most` nodes.
    """
    links = both_ways(edges.select("src", "tgt"))
    counts = degrees(edges)
    first = edges.select(F.explode(F.array("src", "tgt")).alias("label")).filter(F.col("label") == start).limit(1)
    seen = cut(first.withColumn("depth", F.lit(0)).join(counts, "label", "left").fillna(0, ["degree"]))
    frontier, left = seen, most - seen.count()
    for depth in range(1, hops + 1):
        if left <= 0:
            break
        reached = frontier.select(F.col("label").alias("src")).join(links, "src").select(F.col("tgt").alias("label")).distinct().join(seen, "label", "left_anti")
        level = reached.join(counts, "label", "left").fillna(0, ["degree"]).orderBy(F.desc("degree"), "label").limit(left)
        frontier = cut(level.select("label", F.lit(depth).alias("depth"), "degree"))
        found = frontier.count()
        if not found:
            break
        left -= found
        seen = cut(seen.unionByName(frontier))
    return seen


def first_nodes(found: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """The first `most` nodes of a search by depth, degree and label."""
    ranked = found.select("label", "depth").join(degrees(edges), "label", "left").fillna(0, ["degree"])
    return ranked.orderBy("depth", F.desc("degree"), "label").limit(most).select("label", "depth")


def pagerank(edges: DataFrame, rounds: int, anchors: DataFrame | None = None, damping: float = 0.85, anchor_weight: float = 10.0) -> DataFrame:
    """label and rank after a number of rounds over weighted undirected edges (src, tgt, weight).

    The jump prefers anchors (label) by anchor_weight to 1.
    """
    links = both_ways(edges.select("src", "tgt", F.col("weight").cast("double").alias("weight")))
    out = links.groupBy("src").agg(F.sum("weight").alias("total"))
    links = cut(links.join(out, "src").select("src", "tgt", (F.col("weight") / F.col("total")).alias("share")))
    nodes = out.select(F.col("src").alias("label"))
    if anchors is None:
        nodes = nodes.withColumn("w", F.lit(1.0))
    else:
        nodes = nodes.join(anchors.select("label").distinct().withColumn("w", F.lit(anchor_weight)), "label", "left").fillna(1.0, ["w"])
    total = F.broadcast(nodes.agg(F.sum("w").alias("all")))
    hot = hot_hashes(links, ["src"])
    jump = cut(nodes.crossJoin(total).select("label", (F.col("w") / F.col("all")).alias("jump")))
    ranks = jump.select("label", F.col("jump").alias("rank"))
    for i in range(rounds):
        sent = lookup_join(links, ranks.withColumnRenamed("label", "src"), ["src"], hot=hot).groupBy(F.col("tgt").alias("label")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        ranks = jump.join(sent, "label", "left").select("label", (F.col("jump") * (1 - damping) + F.coalesce("got", F.lit(0.0)) * damping).alias("rank"))
        if i % 3 == 2:
            ranks = cut(ranks)
    return ranks


def smart_rank(edges: DataFrame, ranks: DataFrame, anchors: DataFrame) -> DataFrame:
    """src, tgt and the sum of the ends' ranks, doubled between two anchors."""
    r = ranks.select("label", "rank")
    a = anchors.select("label").distinct().withColumn("is_anchor", F.lit(True))
    x = edges.join(r.select(F.col("label").alias("src"), F.col("rank").alias("rs")), "src").join(r.select(F.col("label").alias("tgt"), F.col("rank").alias("rt")), "tgt")
    x = x.join(a.select(F.col("label").alias("src"), F.col("is_anchor").alias("as_")), "src", "left").join(a.select(F.col("label").alias("tgt"), F.col("is_anchor").alias("at_")), "tgt", "left")
    both = F.coalesce(F.col("as_") & F.col("at_"), F.lit(False))
    return x.select("src", "tgt", ((F.col("rs") + F.col("rt")) * F.when(both, 2.0).otherwise(1.0)).alias("smart_rank"))



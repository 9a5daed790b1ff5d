"""Entity resolution and merging of nodes and edges, tracking lists, deletes and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.functions.text import SEP, merge_key
from lodestack.operators.graph import both_ways, canonical

FIFO, KEEP = "FIFO", "KEEP"


def limited(ids: Column, most: int, method: str = FIFO) -> Column:
    """The last (FIFO) or first (KEEP) `most` ids; none for a limit of 0 or less."""
    if most <= 0:
        return F.slice(ids, 1, 0)
    if method.upper() == KEEP:
        return F.slice(ids, 1, most)
    return F.when(F.size(ids) > most, F.slice(ids, -most, most)).otherwise(ids)


def merged_ids(a: Column, b: Column) -> Column:
    """a then b, without repeats and empty ids, in order."""
    both = F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(both, lambda x: x.isNotNull() & (x != "")))


def subtracted_ids(a: Column, b: Column) -> Column:
    """a without the ids of b and empty ones; repeats stay."""
    return F.filter(a, lambda x: x.isNotNull() & (x != "") & ~F.array_contains(F.coalesce(b, F.array().cast("array<string>")), x))


def incremental_ids(current: Column, old: Column, new: Column) -> Column:
    """current without old - new, with new - old that it lacks at the end."""
    empty = F.array().cast("array<string>")
    old, new, current = F.coalesce(old, empty), F.coalesce(new, empty), F.coalesce(current, empty)
    gone, added = F.array_except(old, new), F.array_except(new, old)
    kept = F.filter(current, lambda x: ~F.array_contains(gone, x))
    return F.concat(kept, F.filter(added, lambda x: ~F.array_contains(kept, x)))


def capped_paths(paths: Column, most: int, method: str = FIFO) -> Column:
    """The paths within the cap, and a placeholder where some were cut."""
    mark = F.array(F.lit(f"...truncated...({method})"))
    return F.when(F.size(paths) > most, F.concat(limited(paths, most, method), mark)).otherwise(paths)


def canonical_names(names: DataFrame, name: str, order: str) -> DataFrame:
    """name and the first name with the same merge key."""
    keyed = names.select(F.col(name).alias("name"), F.col(order).alias("__o")).groupBy("name").agg(F.min("__o").alias("__o"))
    keyed = keyed.withColumn("key", merge_key("name"))
    first = keyed.groupBy("key").agg(F.min_by("name", F.struct("__o", "name")).alias("canonical"))
    return keyed.join(first, "key").select("name", "canonical")


def type_votes(rows: DataFrame, name: str, kind: str, order: str) -> DataFrame:
    """name and its most frequent type, the first seen among equals."""
    votes = rows.groupBy(name, kind).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return votes.groupBy(name).agg(F.max_by(kind, F.struct(F.col("n"), -F.col("first"), F.col(kind))).alias(kind))


def ordered_list(value: Column, *order: Column) -> Column:
    """Distinct values of a group in order of their first appearance."""
    pairs = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))))
    return F.array_distinct(F.transform(pairs, lambda x: x.v))


def first_values(rows: DataFrame, keys: list[str], value: str, most: int, method: str = FIFO) -> DataFrame:
    """keys and an ordered list of at most `most` distinct values: the last by FIFO, else the first.

    The list is cut by ranks before it is gathered, so that no group is larger than `most`.
    """
    each = rows.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(F.min("ord").alias("ord"))
    down = method == FIFO
    order = [F.col("ord").desc(), F.col(value).desc()] if down else [F.col("ord"), F.col(value)]
    kept = each.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("n") <= most)
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(value).alias("v")))), lambda x: x.v).alias(f"{value}s"))


def described(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys and description: at most `most` distinct ones, by time and among equals the longer first."""
    each = rows.filter("description <> ''").groupBy(*keys, "description").agg(F.min("ord").alias("ord"))
    order = [F.col("ord"), F.length("description").desc(), F.col("description")]
    kept = each.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("n") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "description"))), lambda x: x.description)
    return kept.groupBy(*keys).agg(F.array_join(listed, SEP).alias("description"))


def merge_nodes(rows: DataFrame, most: int = 300, method: str = FIFO) -> DataFrame:
    """One node an entity from rows (name, type, description, source_id, file_path, ord).

    Equal values are counted before they are shuffled, and lists are cut by rank before they
    are gathered, so that one entity may hold a third of the rows.
    """
    out = type_votes(rows, "name", "type", "ord")
    for part in (described(rows, ["name"], most), first_values(rows, ["name"], "source_id", most, method), first_values(rows, ["name"], "file_path", most, method)):
        out = out.join(part, "name", "left")
    return out


def merge_edges(rows: DataFrame) -> DataFrame:
    """One edge a pair from rows (src, tgt, weight, keywords, source_id): weights summed, keywords united and sorted."""
    edges = canonical(rows)
    base = edges.groupBy("src", "tgt").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n_rows"))
    words = edges.select("src", "tgt", F.explode(F.split(F.coalesce("keywords", F.lit("")), ",")).alias("k")).select("src", "tgt", F.trim("k").alias("k")).filter("k <> ''").distinct()
    united = words.groupBy("src", "tgt").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("keywords"))
    return base.join(united, ["src", "tgt"], "left")


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """label of ends that aren't nodes, to be created with type UNKNOWN."""
    return edges.select(F.explode(F.array("src", "tgt")).alias("label")).distinct().join(nodes.select("label"), "label", "left_anti").withColumn("type", F.lit("UNKNOWN"))


def repointed(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with ends replaced by mapping (label -> target): loops dropped, parallel edges joined at their largest weight."""
    m = mapping.select("label", "target")
    x = edges.join(m.select(F.col("label").alias("src"), F.col("target").alias("s")), "src", "left").join(m.select(F.col("label").alias("tgt"), F.col("target").alias("t")), "tgt", "left")
    moved = x.select(F.coalesce("s", "src").alias("src"), F.coalesce("t", "tgt").alias("tgt"), "weight")
    return canonical(moved).groupBy("src", "tgt").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n_edges"))


STRATEGIES = ("concatenate", "keep_first", "keep_last", "join_unique", "join_unique_comma", "max")


def merged_attribute(value: str, order: str, strategy: str = "keep_first") -> Column:
    """Aggregate of an attribute over merged entities, nulls and empty values left out."""
    v, o = F.col(value), F.col(order)
    given = F.when(v.isNotNull() & (v.cast("string") != ""), v)
    ordered = F.transform(F.array_sort(F.collect_list(F.when(given.isNotNull(), F.struct(o.alias("o"), given.cast("string").alias("v"))))), lambda x: x.v)
    if strategy == "concatenate":
        return F.array_join(ordered, SEP)
    if strategy == "keep_first":
        return F.min_by(given, F.when(given.isNotNull(), o))
    if strategy == "keep_last":
        return F.max_by(given, F.when(given.isNotNull(), o))
    if strategy == "join_unique":
        return F.array_join(F.array_distinct(F.flatten(F.transform(ordered, lambda x: F.split(x, SEP)))), SEP)
    if strategy == "join_unique_comma":
        items = F.transform(F.flatten(F.transform(ordered, lambda x: F.split(x, ","))), lambda x: F.trim(x))
        return F.array_join(F.array_sort(F.array_distinct(F.filter(items, lambda x: x != ""))), ",")
    if strategy == "max":
        return F.max(v.try_cast("double"))
    raise ValueError(f"strategy must be one of {STRATEGIES}")


def renamed(edges: DataFrame, old: str, new: str) -> DataFrame:
    """Edges with an entity renamed; renaming into an existing one merges their edges."""
    return repointed(edges, edges.sparkSession.createDataFrame([(old, new)], "label string, target string"))


def export_edges(edges: DataFrame) -> DataFrame:
    return both_ways(edges)


def custom_graph(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a given graph: source ids mapped to chunk ids (UNKNOWN where absent), missing ends created."""
    ids = chunks.select("source_id", "chunk_id")
    nodes = entities.join(ids, "source_id", "left").select("label", "type", F.coalesce("chunk_id", F.lit("UNKNOWN")).alias("chunk_id"))
    edges = relations.join(ids, "source_id", "left").select("src", "tgt", "weight", F.coalesce("chunk_id", F.lit("UNKNOWN")).alias("chunk_id"))
    made = missing_endpoints(edges, nodes).withColumn("chunk_id", F.lit("UNKNOWN"))
    return nodes.unionByName(made.select(*nodes.columns)), edges



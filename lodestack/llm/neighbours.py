"""The k most similar vectors of every vector (problem 3).

A forest of random-projection trees is fitted on a bounded sample; every vector is put
into one leaf of each tree. A vector searches the leaves that a priority queue shared by
all trees would yield first: the queue's order is the largest margin by which a path
goes against the vector, and because that never falls along a path, keeping the best
`probes` nodes of each level over all trees gives the same leaves. The candidates of a
leaf are reranked exactly, by blocks of matrix products, and the lists of a vector's
leaves are merged. A leaf that would have more than LEAF_MOST vectors, as there are where
the sample can't make the trees any deeper, is searched in several tasks: each has all the
leaf's vectors and a share of those that search it. exact=True makes the whole table one
such leaf.

How many leaves a vector searches and how large they are follows from the data: SAMPLE_QUERIES
sampled vectors are compared with all others, and of the depths and numbers of leaves by
which a share `recall` of their nearest is found the cheapest is taken. `probes` and
`leaf_rows` are the least of both. Leaves also grow where the sample has fewer than
MIN_SAMPLE vectors a leaf; the products run in blocks. Vectors travel normalised in
16-bit fixed point, which keeps cosines to about 1e-5.

Vectors that are equal in this form are one class, so that many copies can't fill a leaf:
a class has its first k + 1 ids as heads, members take each other as neighbours first
(smallest ids first), and no pairs of further copies are made.

Defined cases: null, short, long or zero vectors and vectors with null, infinite or NaN
elements take no part, nor do null ids; a repeated id counts once, with its smallest
packed vector if its rows differ; equal similarities are ordered by class; fewer than
k + 1 vectors give fewer neighbours; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestack.operators.skew import lookup_join
from lodestack.session import Shared, cores, cut, reachable, table

SAMPLE_ROWS = 65_536
MIN_SAMPLE = 8
SAMPLE_QUERIES = 256
MOST_PROBES = 64
LEAF_MOST = 40_000
ROWS_A_TASK = 250_000
# A further leaf costs a vector as much as so many candidates: its copy and its list are shuffled.
COPY_COST = 2500
BLOCK = 512
BLOCK_CELLS = 1 << 22


def pack(flat: np.ndarray) -> np.ndarray:
    """Rows of floats as 16-bit fixed point relative to each row's largest element."""
    top = np.abs(flat).max(1, keepdims=True)
    return np.rint(flat / top * 32767).astype("<i2")


def unpack(packed: pa.Array, dim: int) -> np.ndarray:
    """Packed vectors as rows of unit norm."""
    joined = b"".join(packed.to_pylist())
    x = np.frombuffer(joined, "<i2").reshape(-1, dim).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """id and packed vector of the rows that can take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ok = (sizes == dim) & ids.is_valid().to_numpy(zero_copy_only=False)
            flat = vectors.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            top = np.abs(flat).max(1) if len(flat) else np.zeros(0)
            fit = np.isfinite(top) & (top > 0)
            ids = ids.filter(pa.array(ok)).filter(pa.array(fit))
            rows = pack(flat[fit]) if fit.any() else np.zeros((0, dim), "<i2")
            packed = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.cast(pa.string()), packed], names=["id", "packed"])

    reachable(df.sparkSession)
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id string, packed binary")


def one_vector_per_id(rows: DataFrame) -> DataFrame:
    """rows where no id has two vectors; of differing ones the smallest stays.

    Rows that are repeated as they are fall together with their class later, so vectors
    are only shuffled by id where some id really has differing ones.
    """
    h = F.xxhash64("packed")
    differing = rows.groupBy("id").agg(F.min(h).alias("a"), F.max(h).alias("b")).filter("a <> b").select("id")
    if differing.isEmpty():
        return rows
    kept = rows.groupBy("id").agg(F.min("packed").alias("packed"))
    return kept


def classes(rows: DataFrame, k: int) -> DataFrame:
    """cid, packed vector and the first k + 1 ids of every class of equal vectors."""
    first = W.partitionBy("packed").orderBy("id")
    heads = rows.withColumn("n", F.dense_rank().over(first)).filter(F.col("n") <= k + 1)
    grouped = heads.groupBy("packed").agg(F.array_sort(F.collect_set("id")).alias("heads"))
    return cut(grouped.select(F.monotonically_increasing_id().alias("cid"), "packed", "heads"))


class Forest:
    """Perfect binary trees of hyperplanes, in heap order."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, seed: int):
        self.depth, self.trees = depth, trees
        n, dim = (1 << depth) - 1, sample.shape[1]
        self.planes = np.zeros((trees, n, dim), np.float32)
        self.cuts = np.zeros((trees, n), np.float32)
        rng = np.random.default_rng(seed)
        for t in range(trees):
            parts = {0: np.arange(len(sample))}
            for node in range(n):
                own = parts.pop(node, np.arange(0))
                if len(own) >= 2:
                    plane = self._plane(sample, own, rng)
                    at = sample[own] @ plane
                    self.planes[t, node], self.cuts[t, node] = plane, np.median(at)
                    left = at <= self.cuts[t, node]
                    parts[2 * node + 1], parts[2 * node + 2] = own[left], own[~left]

    @staticmethod
    def _plane(sample: np.ndarray, own: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Direction between two balanced means that start at two random points."""
        few = sample[rng.choice(own, min(256, len(own)), replace=False)]
        a, b = few[0], few[1]
        for _ in range(6):
            at = few @ (a - b)
            side = at > np.median(at)
            if side.all() or not side.any():
                break
            a, b = few[side].mean(0), few[~side].mean(0)
        plane = a - b
        size = np.linalg.norm(plane)
        return plane / size if size > 1e-9 else rng.standard_normal(len(plane)).astype(np.float32)

    def search(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaves (tree * 2^depth + leaf) of each row in queue order, and whether each is its own."""
        rows = np.arange(len(x))[:, None]
        tree = np.tile(np.arange(self.trees), (len(x), 1))
        node = np.zeros_like(tree)
        margin = np.zeros(tree.shape, np.float32)
        own = np.ones(tree.shape, bool)
        for _ in range(self.depth):
            off = np.einsum("nd,nbd->nb", x, self.planes[tree, node]) - self.cuts[tree, node]
            right = off > 0
            tree = np.concatenate([tree, tree], 1)
            node = np.concatenate([2 * node + 1, 2 * node + 2], 1)
            margin = np.concatenate([np.maximum(margin, np.where(right, off, 0)), np.maximum(margin, np.where(right, 0, -off))], 1)
            own = np.concatenate([own & ~right, own & right], 1)
            if tree.shape[1] > probes:
                best = np.argsort(np.where(own, -1, margin), axis=1, kind="stable")[:, :probes]
                tree, node, margin, own = tree[rows, best], node[rows, best], margin[rows, best], own[rows, best]
        return (tree << self.depth) + node - ((1 << self.depth) - 1), own

    def cut_at(self, depth: int) -> Forest:
        """The same trees down to a depth."""
        out = object.__new__(Forest)
        n = (1 << depth) - 1
        out.depth, out.trees, out.planes, out.cuts = depth, self.trees, self.planes[:, :n], self.cuts[:, :n]
        return out

    def ranks(self, x: np.ndarray, near: np.ndarray, of: np.ndarray, probes: int) -> np.ndarray:
        """At which of the leaves that row `of` of x searches each row of near is met; `probes` if at none."""
        leaves, own = self.search(x, probes)
        order = np.argsort(~own, axis=1, kind="stable")
        leaves = np.take_along_axis(leaves, order, 1)
        homes, home = self.search(near, self.trees)
        homes = homes[home].reshape(len(near), self.trees)
        met = (leaves[of][:, :, None] == homes[:, None, :]).any(2)
        return np.where(met.any(1), met.argmax(1), probes)


def fit_forest(found: DataFrame, n: int, dim: int, trees: int, leaf_rows: int, sample_rows: int, seed: int) -> Forest:
    """A forest over a sample of at most sample_rows classes."""
    take = min(n, sample_rows)
    rows = found.select("packed")
    if n > take:
        rows = rows.sample(min(1.0, 1.1 * take / n), seed).limit(take)
    sample = unpack(rows.toArrow().column(0).combine_chunks(), dim)
    depth = 0
    while n > leaf_rows << (depth + 1) and len(sample) >= MIN_SAMPLE << (depth + 1):
        depth += 1
    return Forest(sample, depth, trees, seed)


def true_nearest(found: DataFrame, dim: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sample of vectors, their k nearest among all, and the row of the sample each of these belongs to."""
    spark, n = found.sparkSession, found.count()
    rows = found.select("cid", "packed")
    if n > SAMPLE_QUERIES:
        rows = rows.orderBy(F.xxhash64(F.lit(seed), "packed")).limit(SAMPLE_QUERIES)
    picked = rows.toArrow().combine_chunks()
    x = unpack(picked.column(1).combine_chunks(), dim)
    shared = Shared(spark, (picked.column(0).to_numpy(), x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        best = np.full((len(ids), 0), 0, np.float32)
        vectors = np.zeros((len(ids), 0, dim), np.float32)
        for batch in batches:
            y = unpack(batch.column(1), dim)
            far = 1 - queries @ y.T
            far[ids[:, None] == batch.column(0).to_numpy()] = np.inf
            m = min(k, len(y))
            at = np.argpartition(far, m - 1, axis=1)[:, :m]
            best = np.concatenate([best, np.take_along_axis(far, at, 1)], 1)
            vectors = np.concatenate([vectors, y[at]], 1)
            at = np.argsort(best, axis=1, kind="stable")[:, :k]
            best, vectors = np.take_along_axis(best, at, 1), np.take_along_axis(vectors, at[:, :, None], 1)
        good = np.isfinite(best)
        q, d, v = np.nonzero(good)[0], best[good], vectors[good].astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(d), pa.array([r.tobytes() for r in v], pa.binary())], names=["q", "d", "v"])

    lists = found.select("cid", "packed").mapInArrow(run, "q int, d float, v binary")
    first = W.partitionBy("q").orderBy("d", "v")
    lists = lists.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k).select("q", "v").toArrow()
    near = np.frombuffer(b"".join(lists.column(1).to_pylist()), "<f4").reshape(-1, dim)
    return x, near, lists.column(0).to_numpy()


def fitted(forest: Forest, n: int, x: np.ndarray, near: np.ndarray, of: np.ndarray, probes: int, recall: float) -> tuple[Forest, int]:
    """The forest cut to the depth, and the leaves to search, that find a share `recall` of near at the least cost."""
    best = None
    for depth in range(forest.depth, -1, -1):
        cut_forest = forest.cut_at(depth)
        leaves = forest.trees << depth
        most = min(leaves, max(probes, MOST_PROBES))
        met = np.sort(cut_forest.ranks(x, near, of, most))
        at = met[min(len(met), max(1, int(np.ceil(recall * len(met))))) - 1] if len(met) else 0
        if at < most:
            take = min(leaves, max(probes, int(at) + 1))
            cost = take * (n / (1 << depth) + COPY_COST)
            if best is None or cost < best[0]:
                best = (cost, cut_forest, take)
    return best[1], max(best[2], forest.trees)


def nearest_classes(
    found: DataFrame, dim: int, k: int, trees: int, probes: int, leaf_rows: int, sample_rows: int, seed: int, recall: float, exact: bool = False
) -> DataFrame:
    """cid and its nearest classes, in order, as an array of (d, n, c): 1 - cosine, class and its number of heads."""
    spark = found.sparkSession
    n = found.count()
    if exact:
        trees, probes, leaf_rows = 1, 1, n
    forest = fit_forest(found, n, dim, trees, leaf_rows, sample_rows, seed)
    if forest.depth:
        forest, probes = fitted(forest, n, *true_nearest(found, dim, k, seed), probes, recall)
    shared = Shared(spark, forest)
    tasks = max(1, -(-(n >> forest.depth) // LEAF_MOST))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                leaves, own = forest.search(unpack(part.column(1), dim), probes)
                # Every task of a leaf gets the leaf's own vectors; a vector searches in one of them.
                mine = np.broadcast_to(part.column(0).to_numpy()[:, None, None] % tasks == np.arange(tasks), (*leaves.shape, tasks))
                row, col, task = np.nonzero(mine | own[:, :, None])
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaves[row, col].astype(np.int64) * tasks + task), pa.array(own[row, col]), pa.array(mine[row, col, task]), *(c.take(at) for c in part.columns)],
                    names=["leaf", "own", "searches", *part.schema.names],
                )

    def rerank(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        own, searches = group.column("own").to_numpy(), group.column("searches").to_numpy()
        cid = group.column("cid").to_numpy()
        heads = group.column("c").to_numpy()
        x = unpack(group.column("packed").combine_chunks(), dim)
        index, icid, ic = x[own], cid[own], heads[own]
        x, cid = x[searches], cid[searches]
        out_n, out_d, out_c, ends = [], [], [], [0]
        block = max(1, min(BLOCK, BLOCK_CELLS // max(1, len(index))))
        for lo in range(0, len(x), block):
            far = 1 - x[lo : lo + block] @ index.T
            far[cid[lo : lo + block, None] == icid] = np.inf
            m = min(k, far.shape[1])
            if m and m < far.shape[1]:
                best = np.argpartition(far, m - 1, axis=1)[:, :m]
            else:
                best = np.tile(np.arange(m), (len(far), 1))
            d = np.take_along_axis(far, best, 1)
            good = np.isfinite(d)
            ends.extend((ends[-1] + good.sum(1).cumsum()).tolist())
            out_d.append(d[good]), out_n.append(icid[best][good]), out_c.append(ic[best][good])
        near = pa.StructArray.from_arrays(
            [pa.array(np.concatenate([np.zeros(0, np.float32), *out_d]).astype(np.float32)), pa.array(np.concatenate([icid[:0], *out_n])), pa.array(np.concatenate([ic[:0], *out_c]))],
            names=["d", "n", "c"],
        )
        lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), near)
        return pa.Table.from_arrays([pa.array(cid), lists], names=["cid", "near"])

    sent = found.select("cid", "packed", F.size("heads").cast("tinyint").alias("c"))
    sent = sent.mapInArrow(route, "leaf bigint, own boolean, searches boolean, cid bigint, packed binary, c tinyint")
    parts = max(4 * cores(spark), int(spark.conf.get("spark.sql.shuffle.partitions")), n * probes // ROWS_A_TASK)
    lists = (
        sent.repartition(parts, "leaf").groupBy("leaf")
        .applyInArrow(rerank, "cid bigint, near array<struct<d: float, n: bigint, c: tinyint>>")
    )
    by_class = F.array_sort(F.transform(F.flatten(F.collect_list("near")), lambda x: F.struct(x.n.alias("n"), x.d.alias("d"), x.c.alias("c"))))
    once = F.filter(F.col("all"), lambda x, i: (i == 0) | (F.get(F.col("all"), i - 1)["n"] != x.n))
    ordered = F.slice(F.array_sort(F.transform(once, lambda x: F.struct(x.d.alias("d"), x.n.alias("n"), x.c.alias("c")))), 1, k)
    return lists.groupBy("cid").agg(by_class.alias("all")).select("cid", ordered.alias("near"))


def similar_pairs(
    df: DataFrame, id_col: str = "id", vector_col: str = "content_vector", dim: int = 64, k: int = 10, trees: int = 2,
    probes: int = 5, leaf_rows: int = 1000, sample_rows: int = SAMPLE_ROWS, seed: int = 7,
    recall: float = 0.95, exact: bool = False,
) -> DataFrame:
    """Pairs id_a < id_b where one is among the other's k most similar.

    sample_rows bounds the vectors the trees are fitted on; all are indexed and searched.
    recall is the share of the k nearest that the search is widened to, by a sample. exact
    compares every vector with all others, in blocks.
    """
    rows = one_vector_per_id(packed_vectors(df, id_col, vector_col, dim))
    found = classes(rows, k)
    near = nearest_classes(found, dim, k, trees, max(probes, trees), leaf_rows, sample_rows, seed, recall, exact)
    # With c heads of its own a member needs k - (c - 1) more; `before` counts the heads of nearer classes.
    own = found.select("cid", F.size("heads").alias("own"))
    if found.filter(F.size("heads") > 1).isEmpty():
        near = near.withColumn("need", F.lit(k))
    else:
        near = near.join(own, "cid").withColumn("need", F.lit(k + 1) - F.col("own"))
    prefix = F.transform(
        F.col("near"), lambda x, i: F.struct(x.n.alias("n"), F.aggregate(F.slice(F.col("near"), 1, i), F.lit(0), lambda s, y: s + y.c).alias("before"))
    )
    links = (
        near.select("cid", "need", F.explode(prefix).alias("x")).select("cid", F.col("x.n").alias("n"), (F.col("need") - F.col("x.before")).alias("take"))
        .filter("take > 0")
        .select(
            F.least("cid", "n").alias("lo"), F.greatest("cid", "n").alias("hi"),
            F.when(F.col("cid") < F.col("n"), F.col("take")).cast("tinyint").alias("up"),
            F.when(F.col("cid") > F.col("n"), F.col("take")).cast("tinyint").alias("down"),
        )
    )
    heads = found.select("cid", "heads")
    links = (
        links.repartition("lo").groupBy("lo", "hi").agg(F.max("up").alias("up"), F.max("down").alias("down"))
        .join(heads.select(F.col("cid").alias("lo"), F.col("heads").alias("a")), "lo")
        .join(heads.select(F.col("cid").alias("hi"), F.col("heads").alias("b")), "hi")
    )

    def crossed(left, right):
        return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.struct(F.least(x, y).alias("id_a"), F.greatest(x, y).alias("id_b")))))

    few = lambda ids, n: F.slice(ids, 1, F.coalesce(n.cast("int"), F.lit(0)))
    between = F.array_distinct(F.concat(crossed(F.col("a"), few(F.col("b"), F.col("up"))), crossed(few(F.col("a"), F.col("down")), F.col("b"))))
    out = links.select(F.inline(between))
    copies = found.filter(F.size("heads") > 1)
    within = F.filter(crossed(F.col("heads"), F.col("heads")), lambda p: p.id_a < p.id_b)
    out = out.unionByName(copies.select(F.inline(F.array_distinct(within))))
    crowded = found.filter(F.size("heads") > k)
    if not crowded.isEmpty():
        rest = lookup_join(rows, crowded.select("packed", "heads"), ["packed"]).filter(~F.array_contains("heads", F.col("id"))).select("id", "heads").distinct()
        rest = rest.select("id", F.explode(F.slice("heads", 1, k)).alias("h"))
        out = out.unionByName(rest.select(F.least("id", "h").alias("id_a"), F.greatest("id", "h").alias("id_b")))
    return out


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_found: pairs of relations, one among the ten most similar of the other."""
    return similar_pairs(table(spark, sf_dir, "ekr_vdb_relation").select("id", "content_vector"))


QUERIES = {"p3_found": p3_found}
ORACLES: dict[str, str] = {}

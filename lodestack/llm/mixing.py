"""Mixing of sources to target shares of the total size in tokens (problem 7).

Every source gets a budget of tokens: its target share of the total. The total is given
or is the largest for which each usable source can fill its share without using a document
more than max_repeat times; usable are sources with a share, tokens and a max_repeat above
0. The others add nothing, so the shares reached of the usable ones are their targets over
the sum of these. Complete epochs come first: every document of a
source is taken floor(budget / size of the source) times. The rest is sampled without
replacement by Efraimidis and Spirakis: each document has the key -ln(u) / weight with a
uniform u from its id, and the weight is the document's quality: a given column, or how
well a model of byte trigrams, counted in all documents, foresees its text, against the
median of all documents and their median distance from it. The documents of smallest key are taken while their prefix sum
of tokens stays within the rest (the document at the edge if it brings the sum nearer).

A source may hold any part of the rows, so nothing is sorted per source: keys fall into
ranges of about RANGE_ROWS rows, the ranges are summed map-side, and only the one range of
each source that contains the edge is put in order.

Defined cases: documents without tokens (null or empty texts) can't fill a budget and are
left out; sources that are null or not in the targets have no share and are left out;
a target without documents is reported with no tokens; a source that is a target twice is
an error; equal keys are taken in order of
doc_id; repeated rows are documents of their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.llm.bpe import encode_column
from lodestack.session import Shared, cut, spread, table

LEAST_RANGES, RANGE_ROWS = 4096, 1_000_000
MAX_SOURCES = 10_000
LEAST_WEIGHT = 0.05
PAIRS, TRIGRAMS = 1 << 16, 1 << 18
SCORE_DIGITS = 4
# Cells that are counted at once, which bounds memory.
MOST_WAITING = 1 << 21


class Quality:
    """How well the bytes of a text follow from the two before each, as a score and as a weight from LEAST_WEIGHT to 1."""

    def __init__(self, texts: list[str]):
        self._count(tallied(texts))
        scores = Counter(self.scores(texts).tolist())
        self.middle, self.spread = middle_and_spread(list(scores), list(scores.values()))

    @classmethod
    def of(cls, cells: np.ndarray) -> Quality:
        """The model of counted cells; it has scores, but no weights."""
        new = cls.__new__(cls)
        new._count(cells)
        return new

    def _count(self, cells: np.ndarray) -> None:
        # Cells are shared by chance, so a pair is at least as frequent as its triples.
        self.pairs, self.triples = cells[:PAIRS].astype(np.float32), cells[PAIRS:].astype(np.float32)

    @staticmethod
    def _cells(text: str) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
        two = (data[:-2] << np.uint32(8)) | data[1:-1]
        three = (((two << np.uint32(8)) | data[2:]) * np.uint32(2654435761)) >> np.uint32(14)
        return two, three

    def score(self, text: str) -> float | None:
        """Mean log-likelihood of a byte; None for texts of fewer than three."""
        if len(text.encode("utf-8", "replace")) < 3:
            return None
        two, three = self._cells(text)
        return float(np.log((self.triples[three] + 0.1) / (np.maximum(self.pairs[two], self.triples[three]) + 25.6)).mean())

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of the texts to SCORE_DIGITS, NaN without one."""
        found = [self.score(text) if text else None for text in texts]
        return np.round(np.array([np.nan if x is None else x for x in found], np.float64), SCORE_DIGITS)

    def weights(self, texts: list[str | None]) -> np.ndarray:
        z = np.clip((self.scores(texts) - self.middle) / self.spread, -30.0, 30.0)
        return np.where(np.isnan(z), LEAST_WEIGHT, np.maximum(LEAST_WEIGHT, 1 / (1 + np.exp(-1.5 - z))))


def tallied(texts: Iterable[str | None]) -> np.ndarray:
    """How often each cell of pairs, then of triples, occurs in the texts."""
    cells, waiting, size = np.zeros(PAIRS + TRIGRAMS, np.int64), [], 0
    for text in texts:
        if text:
            two, three = Quality._cells(text)
            waiting += [two, three + np.uint32(PAIRS)]
            size += 2 * len(two)
        if size > MOST_WAITING:
            cells += np.bincount(np.concatenate(waiting), minlength=len(cells))
            waiting, size = [], 0
    return cells + np.bincount(np.concatenate(waiting), minlength=len(cells)) if waiting else cells


def middle_and_spread(values: list[float], times: list[int]) -> tuple[float, float]:
    """The median of values that occur so many times, and their spread by the median distance from it; NaN doesn't count."""

    def median(x: np.ndarray) -> float:
        order = np.argsort(x, kind="stable")
        upto = np.cumsum(n[order])
        low, high = np.searchsorted(upto, [(upto[-1] - 1) // 2 + 1, upto[-1] // 2 + 1])
        return float((x[order[low]] + x[order[high]]) / 2)

    x, n = np.array(values, np.float64), np.array(times, np.int64)
    x, n = x[~np.isnan(x)], n[~np.isnan(x)]
    if not len(x):
        return 0.0, 0.1
    middle = median(x)
    return middle, max(0.1, 1.4826 * median(np.abs(x - middle)))


def fitted_quality(docs: DataFrame) -> Quality:
    """The model of all documents. Each task sends the cells it met once, however many documents it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = tallied(text for batch in batches for text in batch.column(0).to_pylist())
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(cells[at])], names=["cell", "n"])

    rows = spread(docs.filter("text <> ''").select("text")).mapInArrow(run, "cell int, n bigint")
    # At most PAIRS + TRIGRAMS rows.
    found = rows.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cells = np.zeros(PAIRS + TRIGRAMS, np.int64)
    cells[found["cell"]] = found["n"]
    return Quality.of(cells)


def uniform(seed: int, *columns: str) -> Column:
    """A number in (0, 1) that depends on the columns and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def sized_documents(docs: DataFrame, seed: int = 0, path: str | None = None, weight: Column | None = None) -> DataFrame:
    """doc_id, source, n_tokens and key of every document, computed once.

    A given weight that is null or not above 0 counts as LEAST_WEIGHT.
    """
    if weight is None:
        quality = Shared(docs.sparkSession, fitted_quality(docs))
        sized = cut(encode_column(docs.select("doc_id", "source", "text"), "text", "n_tokens", path, True, ("score", lambda texts: quality.value.scores(texts))))
        # Scores have few digits, so there are few of them.
        found = sized.groupBy("score").agg(F.count(F.lit(1)).alias("n")).toPandas()
        middle, width = middle_and_spread(found["score"].tolist(), found["n"].tolist())
        z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), (F.col("score") - F.lit(middle)) / F.lit(width)))
        by_score = F.greatest(F.lit(LEAST_WEIGHT), 1 / (1 + F.exp(-1.5 - z)))
        return sized.select("doc_id", "source", "n_tokens", _key(seed, F.when(F.isnan("score"), F.lit(LEAST_WEIGHT)).otherwise(by_score)))
    given = F.when(weight > 0, weight).otherwise(F.lit(LEAST_WEIGHT)).cast("double")
    sized = encode_column(docs.select("doc_id", "source", "text", given.alias("weight")), "text", "n_tokens", path, True)
    return cut(sized.select("doc_id", "source", "n_tokens", _key(seed, F.col("weight"))))


def _key(seed: int, weight: Column) -> Column:
    return (-F.log(uniform(seed, "doc_id")) / weight).alias("key")


def ranged(sized: DataFrame) -> DataFrame:
    """With the range of keys that each document is in; there are more ranges the more documents there are."""
    ranges = max(LEAST_RANGES, sized.count() // RANGE_ROWS)
    return sized.withColumn("range", F.floor(F.col("key") / (F.col("key") + 1) * ranges).cast("int"))


def budgets(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """A row per target source: its size, budget, epochs, rest and the range where the rest ends.

    sized has ranges.

    The targets are settings, not data; more than MAX_SOURCES of them are refused, which
    bounds what is broadcast.
    """
    if targets.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    twice = targets.filter("source IS NOT NULL").groupBy("source").count().filter("count > 1").orderBy("source").first()
    if twice:
        raise ValueError(f"source {twice['source']} is a target twice")
    ranges = sized.filter("n_tokens > 0").groupBy("source", "range").agg(F.sum("n_tokens").alias("tokens"))
    sizes = ranges.groupBy("source").agg(F.sum("tokens").alias("available"))
    plan = F.broadcast(targets.filter("source IS NOT NULL").select("source", "target_share", "max_repeat"))
    plan = plan.join(sizes, "source", "left").fillna(0, ["available"])
    capacity = F.col("available").cast("double") * F.greatest(F.coalesce("max_repeat", F.lit(0)), F.lit(0))
    if total_tokens is None:
        feasible = F.min(F.when((F.col("target_share") > 0) & (capacity > 0), capacity / F.col("target_share")))
        plan = plan.crossJoin(F.broadcast(plan.agg(F.coalesce(feasible, F.lit(0.0)).alias("total"))))
    else:
        plan = plan.withColumn("total", F.lit(float(total_tokens)))
    plan = (
        plan.withColumn("budget", F.least(capacity, F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)) * F.col("total")))
        .withColumn("epochs", F.coalesce(F.floor(F.try_divide(F.col("budget"), F.col("available").cast("double"))), F.lit(0)).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))
    )
    sums = F.sum("tokens").over(W.partitionBy("source").orderBy("range"))
    edges = (
        ranges.withColumn("before", sums - F.col("tokens")).join(F.broadcast(plan.select("source", "rest")), "source")
        .filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") >= F.col("rest")))
        .select("source", F.col("range").alias("edge"), "before")
    )
    return plan.join(edges, "source", "left")


def mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """doc_id, source, copies and n_tokens of each document used, and how often."""
    sized = ranged(sized)
    plan = F.broadcast(cut(budgets(sized, targets, total_tokens)).select("source", "epochs", "rest", "edge", "before"))
    rows = sized.filter("n_tokens > 0").join(plan, "source")
    inner = rows.filter(F.col("edge").isNull() | (F.col("range") != F.col("edge"))).withColumn(
        "more", F.when(F.col("edge").isNull(), F.col("rest") > 0).otherwise(F.col("range") < F.col("edge"))
    )
    upto = F.col("before") + F.sum("n_tokens").over(
        W.partitionBy("source").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    )
    since = F.col("upto") - F.col("n_tokens")
    edge = rows.filter(F.col("range") == F.col("edge")).withColumn("upto", upto).withColumn(
        "more", (since < F.col("rest")) & ((F.col("upto") <= F.col("rest")) | (F.col("upto") - F.col("rest") < F.col("rest") - since))
    )
    taken = inner.unionByName(edge.drop("upto"))
    return (
        taken.withColumn("copies", F.col("epochs") + F.col("more").cast("int"))
        .filter("copies > 0").select("doc_id", "source", "copies", "n_tokens")
    )


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """What each target source reached: documents, tokens, most repeats, actual and target share."""
    used = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most_copies")
    )
    whole = used.agg(F.sum("tokens").alias("whole"))
    return (
        targets.filter("source IS NOT NULL").select("source", "target_share", "max_repeat")
        .join(used, "source", "left").fillna(0, ["n_docs", "tokens", "most_copies"]).crossJoin(F.broadcast(whole))
        .withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("whole")), F.lit(0.0))).drop("whole")
    )


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_mix: the documents of the mixture with the number of times each is used."""
    return mix(sized_documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_shares: target and actual share of every source."""
    return shares(p7_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
ORACLES: dict[str, str] = {}

"""Windows, sections, pages and neighbours of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import words

NEIGHBOUR_STEPS, NEIGHBOUR_ANCHORS = (1, 2), 5


def checked(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and the overlap smaller than it")


def window_starts(n: Column, size: int, overlap: int, stop_at_end: bool = False) -> Column:
    """Starts of windows over n tokens. With stop_at_end no window lies within the one before."""
    step = size - overlap
    last = F.greatest(F.lit(0), n - overlap - 1) if stop_at_end else n - 1
    return F.when(n > 0, F.sequence(F.lit(0), last, F.lit(step)))


def windows(df: DataFrame, tokens: str, size: int, overlap: int, stop_at_end: bool = False) -> DataFrame:
    """df's other columns with chunk_order_index, start, n_tokens and content of each window of tokens."""
    checked(size, overlap)
    keep = [c for c in df.columns if c != tokens]
    rows = df.select(*keep, tokens, F.posexplode(window_starts(F.size(tokens), size, overlap, stop_at_end)).alias("chunk_order_index", "start"))
    part = F.slice(F.col(tokens), F.col("start") + 1, F.lit(size))
    return rows.select(*keep, F.col("chunk_order_index").cast("bigint"), F.col("start").cast("bigint"), F.size(part).cast("bigint").alias("n_tokens"), F.array_join(part, " ").alias("content"))


def sections(df: DataFrame, text: str, separator: str) -> DataFrame:
    """df's other columns with chunk_order_index and content of each section that a separator opens; blank ones are skipped."""
    keep = [c for c in df.columns if c != text]
    quoted = r"\Q" + separator + r"\E"
    parts = F.filter(F.split(F.col(text), f"(?={quoted})"), lambda p: F.regexp_replace(p, r"[ \t\r\n]", "") != "")
    return df.select(*keep, F.posexplode(parts).alias("pos", "content")).select(*keep, F.col("pos").cast("bigint").alias("chunk_order_index"), "content")


def split_then_window(df: DataFrame, text: str, separator: str, size: int, overlap: int, page_ends: str | None = None, only: bool = False) -> DataFrame:
    """df's other columns with chunk_order_index, n_tokens, content, start and page_start of the chunks of a text.

    A section starts with its separator. Sections of more than size words become windows of
    words; with `only` they are an error. Blank sections get no number. start counts the
    words of the document before the chunk; page_start is the page that has it, by the
    pages' cumulative numbers of words in page_ends.
    """
    checked(size, overlap)
    keep = [c for c in df.columns if c not in (text, page_ends)]
    parts = F.split(F.col(text), "(?=" + r"\Q" + separator + r"\E)")
    sized = F.transform(parts, lambda p: F.struct(p.alias("p"), words(p).alias("t")))
    before = F.aggregate(
        F.col("s"), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda a, x: F.struct((a.at + F.size(x.t)).alias("at"), F.concat(a["all"], F.array(a.at)).alias("all")),
    )["all"]
    chunk = lambda n, content, start: F.struct(n.cast("bigint").alias("n_tokens"), content.alias("content"), start.cast("bigint").alias("start"))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")

    def chunks_of(x, i):
        n, at = F.size(x.t), F.get(F.col("b"), i)
        many = F.transform(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)),
            lambda w: chunk(F.least(F.lit(size), n - w), F.array_join(F.slice(x.t, w + 1, size), " "), at + w),
        )
        return F.when(n > size, many).otherwise(F.array(chunk(n, strip(x.p), at)))

    rows = df.select(*keep, *([page_ends] if page_ends else []), sized.alias("s")).withColumn("b", before)
    if only:
        longest = F.exists("s", lambda x: F.size(x.t) > size)
        rows = rows.withColumn("s", F.when(longest, F.raise_error(F.lit(f"a section has more than {size} words")).cast(rows.schema["s"].dataType)).otherwise(F.col("s")))
    flat = F.filter(F.flatten(F.transform("s", chunks_of)), lambda c: c.content != "")
    out = rows.select(*keep, *([page_ends] if page_ends else []), F.posexplode(flat).alias("chunk_order_index", "c"))
    page = page_of(F.col("c.start"), F.col(page_ends)).cast("bigint") if page_ends else F.lit(None).cast("bigint")
    return out.select(*keep, F.col("chunk_order_index").cast("bigint"), "c.n_tokens", "c.content", "c.start", page.alias("page_start"))


def page_of(offset: Column, ends: Column) -> Column:
    """Number, from 1, of the page that holds a token offset; ends are the pages' cumulative token counts."""
    after = F.filter(F.transform(ends, lambda e, i: F.struct(e.alias("end"), (i + 1).alias("page"))), lambda x: x.end > offset)
    return F.coalesce(F.get(after, F.lit(0))["page"], F.size(ends))


def neighbours(anchors: DataFrame, chunks: DataFrame, workspaces: bool = True) -> DataFrame:
    """Chunks that follow the first anchors of each query by one or two places and aren't anchors.

    anchors have query_id, workspace, chunk_id and rank; chunks have workspace, chunk_id,
    full_doc_id and chunk_order_index. The nearest anchor counts. Without workspaces there
    is no such column.
    """
    own = ["workspace"] if workspaces else []
    doc = [*own, "full_doc_id"]
    at = anchors.filter(F.col("rank") <= NEIGHBOUR_ANCHORS).join(chunks, [*own, "chunk_id"])
    wanted = at.select("query_id", *doc, "rank", F.explode(F.array(*[F.lit(s) for s in NEIGHBOUR_STEPS])).alias("step"), "chunk_order_index")
    wanted = wanted.withColumn("chunk_order_index", F.col("chunk_order_index") + F.col("step"))
    met = wanted.join(chunks, [*doc, "chunk_order_index"]).groupBy("query_id", *own, "chunk_id").agg(F.min(F.struct("rank", "step")).alias("from"))
    return met.join(anchors, ["query_id", *own, "chunk_id"], "left_anti").select(
        "query_id", *own, "chunk_id", F.col("from.rank").alias("anchor_rank"), F.col("from.step").cast("bigint").alias("step")
    )

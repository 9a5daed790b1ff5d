"""What a prompt gets: entity, relation and chunk lines within budgets, with numbered files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def entity_line(name: str, kind: str, description: str) -> Column:
    return F.concat(F.lit("- "), F.col(name), F.lit(" ("), F.coalesce(F.col(kind), F.lit("UNKNOWN")), F.lit("): "), F.coalesce(F.col(description), F.lit("")))


def relation_line(src: str, tgt: str, description: str) -> Column:
    return F.concat(F.lit("- "), F.col(src), F.lit(" <-> "), F.col(tgt), F.lit(": "), F.coalesce(F.col(description), F.lit("")))


def chunk_block(reference: str, content: str, page: str | None = None, heading: str | None = None) -> Column:
    """A tagged chunk; double quotes of headings become single ones."""
    parts = [F.lit('<chunk reference_id="'), F.col(reference).cast("string"), F.lit('"')]
    if page:
        parts.append(F.when(F.col(page).isNotNull(), F.concat(F.lit(' page="'), F.col(page).cast("string"), F.lit('"'))).otherwise(""))
    if heading:
        quoted = F.replace(F.col(heading), F.lit('"'), F.lit("'"))
        parts.append(F.when(F.coalesce(F.col(heading), F.lit("")) != "", F.concat(F.lit(' heading="'), quoted, F.lit('"'))).otherwise(""))
    return F.concat(*parts, F.lit(">\n"), F.col(content), F.lit("\n</chunk>"))


def reference_line(number: str, path: str) -> Column:
    return F.concat(F.lit("["), F.col(number).cast("string"), F.lit("] "), F.col(path))


def rendered(lines: DataFrame, line: str, order: str, out: str, groups: tuple[str, ...] = ("query_id",), between: str = "\n") -> DataFrame:
    """Lines of each group in order, one text. Groups are result lists already cut to a budget."""
    return lines.groupBy(*groups).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))), lambda x: x.l), between).alias(out)
    )


def merged_queries(rows: DataFrame) -> DataFrame:
    """question_id, what, key, position, reference_id of results of sub-queries (question_id, sub, what, key, rank, file_path).

    Of each kind the first appearance of a key counts, in the order of sub-queries and
    ranks; files are numbered anew by their first appearance in a question.
    """
    first = F.row_number().over(W.partitionBy("question_id", "what", "key").orderBy("sub", "rank"))
    kept = rows.withColumn("n", first).filter("n = 1")
    position = F.row_number().over(W.partitionBy("question_id", "what").orderBy("sub", "rank")).cast("bigint")
    files = rows.filter("what = 'chunk' AND file_path <> ''").groupBy("question_id", "file_path").agg(F.min(F.struct("sub", "rank")).alias("at"))
    number = F.row_number().over(W.partitionBy("question_id").orderBy("at")).cast("bigint")
    files = files.select("question_id", "file_path", number.alias("reference_id"))
    return kept.withColumn("position", position).join(files, ["question_id", "file_path"], "left").select("question_id", "what", "key", "position", "reference_id")


def merged_keywords(rows: DataFrame) -> DataFrame:
    """question_id, level and keywords: those of its sub-queries (question_id, sub, level, pos, keyword) in order, each once."""
    first = rows.groupBy("question_id", "level", "keyword").agg(F.min(F.struct("sub", "pos")).alias("at"))
    return first.groupBy("question_id", "level").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "keyword"))), lambda x: x.keyword).alias("keywords"))


def summed_info(rows: DataFrame) -> DataFrame:
    """question_id, name and value: the numbers that the sub-queries report, summed."""
    return rows.groupBy("question_id", "name").agg(F.sum("value").alias("value"))

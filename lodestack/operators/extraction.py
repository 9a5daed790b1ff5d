"""Records that a model wrote: parsed, repaired, merged with a second pass, joined with the cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import extracted_name, identifier, is_number, repaired_delimiters, sanitize

FIELD, DONE = "<|#|>", "<|COMPLETE|>"
BAD_TYPE = r"['\"()<>|/\\]"


def records(df: DataFrame, response: str, keep: list[str]) -> DataFrame:
    """keep, pos and fields of every record of the responses, delimiters repaired.

    Records end with a line, with the closing marker in any case, or where a delimiter stands
    before the name of the next record's kind. A record that names no kind is an entity.
    """
    text = repaired_delimiters(F.regexp_replace(F.col(response), r"(?i)<\|complete\|>", "\n"))
    text = F.regexp_replace(text, r"<\|#\|>[ \t]*(?=(?:entity|relation|relationship)[ \t]*<\|#\|>)", "\n")
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    rows = df.select(*keep, F.posexplode(lines).alias("pos", "line"))
    line = F.trim("line")
    named = F.when(line.rlike(r"(?i)^\W{0,3}(?:entity|relation)"), line).otherwise(F.concat(F.lit("entity" + FIELD), line))
    fields = F.transform(F.split(named, r"<\|#\|>"), lambda x: F.trim(x))
    return rows.filter(F.contains("line", F.lit(FIELD))).select(*keep, F.col("pos").cast("bigint"), fields.alias("fields"))


def entities(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """name, type and description of the entity records: four fields, a name, a plain type, a description."""
    f = [F.get("fields", F.lit(i)) for i in range(4)]
    rows = parsed.filter((F.size("fields") == 4) & F.contains(F.lower(f[0]), F.lit("entity"))).select(
        *keep, "pos", identifier(extracted_name(f[1])).alias("name"), F.replace(F.lower(extracted_name(f[2])), F.lit(" "), F.lit("")).alias("type"),
        sanitize(f[3]).alias("description"),
    )
    return rows.filter((F.col("name") != "") & (F.col("type") != "") & ~F.col("type").rlike(BAD_TYPE) & (F.col("description") != ""))


def relations(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """src, tgt, keywords, description and weight of the relation records: five fields, two different ends."""
    f = [F.get("fields", F.lit(i)) for i in range(5)]
    weight = F.when(is_number(F.trim(f[4])), F.expr("try_cast(trim(get(fields, 4)) AS double)")).otherwise(F.lit(1.0))
    rows = parsed.filter((F.size("fields") == 5) & F.contains(F.lower(f[0]), F.lit("relation"))).select(
        *keep, "pos", identifier(extracted_name(f[1])).alias("src"), identifier(extracted_name(f[2])).alias("tgt"),
        F.replace(f[3], F.lit("，"), F.lit(",")).alias("keywords"), sanitize(f[4]).alias("description"), weight.alias("weight"),
    )
    return rows.filter((F.col("src") != "") & (F.col("tgt") != "") & (F.col("src") != F.col("tgt")))


def gleaned(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The records of two passes: of a record in both, the longer description."""
    a, b = first.select(*keys, F.col("description").alias("d1")), second.select(*keys, F.col("description").alias("d2"))
    longer = F.when(F.length("d2") > F.length("d1"), F.col("d2")).otherwise(F.coalesce("d1", "d2"))
    return a.join(b, keys, "full_outer").select(*keys, longer.alias("description"))


def cached_extractions(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """workspace, chunk_id, cache_id and rank of the cached extractions of chunks, oldest first."""
    from pyspark.sql import Window as W

    refs = chunks.select("workspace", F.col("id").alias("chunk_id")).distinct()
    calls = cache.filter("cache_type = 'extract'").select("workspace", "chunk_id", F.col("id").alias("cache_id"), "create_time")
    met = calls.join(refs, ["workspace", "chunk_id"])
    rank = F.row_number().over(W.partitionBy("workspace", "chunk_id").orderBy("create_time", "cache_id")).cast("bigint")
    return met.withColumn("rank", rank).select("workspace", "chunk_id", "cache_id", "rank")

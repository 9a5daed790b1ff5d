"""Readers: text documents, parser output, graph files, key-value files, given graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.session import cut
from lodestack.sources import stores

TEXT_SUFFIXES, PDF_SUFFIXES = ("txt", "md", "markdown"), ("pdf",)
PAGE = "array<struct<page_number:int,content:string,images:array<string>>>"


def read_text(spark: SparkSession, path: str, suffixes_only: bool = False) -> DataFrame:
    """path, content and pages of text files; each is one page, number 1. Other suffixes fail by name, or are left out."""
    rows = spark.read.format("binaryFile").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = suffix.isin(*TEXT_SUFFIXES)
    rows = (rows.filter(known) if suffixes_only else rows).select("path", "content")
    message = F.concat(F.lit("unsupported file type ."), suffix, F.lit("; supported: .txt .md .markdown, .pdf by its parser output"))
    text = F.when(known, F.expr("make_valid_utf8(CAST(content AS STRING))")).otherwise(F.raise_error(message).cast("string"))
    page = F.array(F.struct(F.lit(1).alias("page_number"), F.col("text").alias("content"), F.array().cast("array<string>").alias("images")))
    return rows.select("path", text.alias("text")).select("path", F.col("text").alias("content"), page.cast(PAGE).alias("pages"))


def read_documents(spark: SparkSession, path: str, parser: str | None = None, timeout: float = 1800) -> DataFrame:
    """path, content, pages and error of documents: text files as they are, PDF files by the parser command.

    Files of other kinds have an error that names the kinds there are, as have PDF files
    without a parser and those it fails for; other files go on.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    empty = F.lit(None).cast("string")
    texts = read_text(spark, path, suffixes_only=True).withColumn("error", empty)
    pdfs = files.filter(suffix.isin(*PDF_SUFFIXES))
    known = [*TEXT_SUFFIXES, *PDF_SUFFIXES]
    message = F.concat(F.lit("unsupported file type ."), suffix, F.lit("; supported: " + " ".join(f".{s}" for s in known)))
    other = files.filter(~suffix.isin(*known)).select("path", empty.alias("content"), F.lit(None).cast(PAGE).alias("pages"), message.alias("error"))
    if parser is None:
        parsed = pdfs.select("path", empty.alias("content"), F.lit(None).cast(PAGE).alias("pages"), F.lit("a .pdf needs a parser").alias("error"))
    else:
        got = cut(stores.parse_pdfs(pdfs, parser, timeout))
        pages = stores.pages_of_lists(got).select("path", F.col("pages").cast(PAGE).alias("pages"))
        content = F.array_join(F.transform("pages", lambda p: p.content), "\n")
        parsed = got.join(pages, "path", "left").select("path", content.alias("content"), "pages", "error")
    return texts.unionByName(parsed).unionByName(other)


CONTENT_ITEM = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("table_body", T.StringType()),
    T.StructField("img_path", T.StringType()), T.StructField("page_idx", T.IntegerType()),
])


def read_content_list(spark: SparkSession, path: str) -> DataFrame:
    """file and pages of a parser's content lists: per page the text and table bodies in order, and image paths."""
    items = spark.read.schema(CONTENT_ITEM).option("multiLine", True).json(path)
    rows = items.withColumn("file", F.input_file_name()).withColumn("n", F.monotonically_increasing_id()).filter("page_idx IS NOT NULL")
    part = F.when(F.col("type") == "table", F.col("table_body")).otherwise(F.col("text"))
    per_page = rows.groupBy("file", "page_idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct("n", part.alias("t"))))), lambda x: x.t), "\n").alias("content"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("img_path").isNotNull(), F.struct("n", "img_path")))), lambda x: x.img_path).alias("images"),
    )
    page = F.struct((F.col("page_idx") + 1).alias("page_number"), "content", "images")
    return per_page.groupBy("file").agg(F.array_sort(F.collect_list(page)).alias("pages"))


def cached_parse(spark: SparkSession, root: str, stem: str) -> str | None:
    """The first parser output of a document in any folder below root, however deep, or None."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    start = jvm.org.apache.hadoop.fs.Path(root)
    fs = start.getFileSystem(conf)
    if not fs.exists(start):
        return None
    files, found = fs.listFiles(start, True), []
    while files.hasNext():
        path = files.next().getPath()
        if path.getName() == f"{stem}_content_list.json":
            found.append(path.toString())
    return min(found, default=None)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (label, data) and edges (src, tgt, data) of a GraphML file."""
    data = "array<struct<_key:string,_VALUE:string>>"
    as_map = F.map_from_entries(F.coalesce("data", F.array().cast(data)))
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, data {data}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, data {data}").load(path)
    return nodes.select(F.col("_id").alias("label"), as_map.alias("data")), edges.select(F.col("_source").alias("src"), F.col("_target").alias("tgt"), as_map.alias("data"))


def read_kv_json(spark: SparkSession, path: str, value: T.StructType) -> DataFrame:
    """id and the value's fields of a JSON object that maps ids to values."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", T.MapType(T.StringType(), value))
    return text.select(F.explode(entries).alias("id", "v")).select("id", "v.*")

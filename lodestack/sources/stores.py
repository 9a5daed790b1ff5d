"""Readers and writers of other stores: relational, vector and graph databases, their exports, spreadsheets."""

from __future__ import annotations

import base64
import os
import shlex
import subprocess
import tempfile
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions.text import without_control
from lodestack.session import reachable


def jdbc_table(
    spark: SparkSession, url: str, name: str, workspace: str | None = None, ids: Sequence[str] | None = None, workspaces: Sequence[str] = (), **options: str
) -> DataFrame:
    """A table of a relational store, one task a workspace where several are given.

    The filters on workspace and ids are pushed to the database. More than 1,000 ids are an
    error: join with a DataFrame of ids instead.
    """
    if ids is not None and len(ids) > 1000:
        raise ValueError("more than 1,000 ids; join with them instead")
    if workspaces:
        quoted = ["workspace = '" + w.replace("'", "''") + "'" for w in workspaces]
        df = spark.read.jdbc(url, name, predicates=quoted, properties=dict(options))
    else:
        df = spark.read.jdbc(url, name, properties=dict(options))
    low = {c.lower(): c for c in df.columns}
    df = df.select(*[F.col(c).alias(k) for k, c in low.items()])
    if workspace is not None:
        df = df.filter(F.col("workspace") == workspace)
    return df if ids is None else df.filter(F.col("id").isin(*ids))


def vector_text(column: Column | str) -> Column:
    """The vector that a database writes as [1,2,3]."""
    return F.from_json(column, "array<float>")


def agtype(column: Column | str) -> Column:
    """A graph value that a database writes as JSON and a type: a struct of kind, id, label, start_id, end_id and properties."""
    c = F.col(column) if isinstance(column, str) else column
    body = F.from_json(F.regexp_replace(c, r"::(?:vertex|edge|path)\s*$", ""), "id bigint, label string, start_id bigint, end_id bigint, properties map<string,string>")
    return F.struct(
        F.nullif(F.regexp_extract(c, r"::(vertex|edge|path)\s*$", 1), F.lit("")).alias("kind"), body["id"].alias("id"), body["label"].alias("label"),
        body["start_id"].alias("start_id"), body["end_id"].alias("end_id"), body["properties"].alias("properties"),
    )


def agtype_graph(rows: DataFrame, column: str, name: str = "entity_id") -> tuple[DataFrame, DataFrame]:
    """Nodes (label, data) and edges (src, tgt, data) of rows of such graph values."""
    v = rows.select(agtype(column).alias("v"))
    nodes = v.filter("v.kind = 'vertex'").select("v.id", F.col("v.properties")[name].alias("label"), F.col("v.properties").alias("data"))
    edges = v.filter("v.kind = 'edge'").select("v.start_id", "v.end_id", F.col("v.properties").alias("data"))
    ends = nodes.select("id", "label")
    x = edges.join(ends.select(F.col("id").alias("start_id"), F.col("label").alias("src")), "start_id").join(ends.select(F.col("id").alias("end_id"), F.col("label").alias("tgt")), "end_id")
    return nodes.select("label", "data"), x.select("src", "tgt", "data")


def read_graph_lines(spark: SparkSession, path: str, name: str = "entity_id") -> tuple[DataFrame, DataFrame]:
    """Nodes (label, data) and edges (src, tgt, data) of a graph database's export: a JSON object a line, of type node or relationship."""
    end = "struct<id:string,properties:map<string,string>>"
    schema = f"type string, id string, labels array<string>, label string, properties map<string,string>, start {end}, `end` {end}"
    rows = spark.read.schema(schema).json(path)
    nodes = rows.filter("type = 'node'").select(F.col("properties")[name].alias("label"), F.col("properties").alias("data"))
    edges = rows.filter("type = 'relationship'").select(F.col("start.properties")[name].alias("src"), F.col("end.properties")[name].alias("tgt"), F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("data"))
    return nodes, edges


def graph_database(spark: SparkSession, url: str, query: str, source: str = "org.neo4j.spark.DataSource", **options: str) -> DataFrame:
    """Rows of a query in a graph database, by its own connector if the session has it."""
    return spark.read.format(source).option("url", url).option("query", query).options(**options).load()


def read_collection(spark: SparkSession, path: str, vector: str = "vector", fields: str = "id string, content string") -> DataFrame:
    """Rows of a vector database's export: objects a line, or an object with the list `rows`."""
    schema = T._parse_datatype_string(f"{fields}, `{vector}` array<float>")
    whole = T.StructType([T.StructField("rows", T.ArrayType(schema)), *schema.fields])
    read = spark.read.schema(whole).option("multiLine", True).json(path)
    names = [f.name for f in schema.fields]
    listed = read.filter("rows IS NOT NULL").select(F.inline("rows"))
    # Files of one object a line are read line by line.
    lines = spark.read.schema(T.StructType([T.StructField("rows", T.ArrayType(T.StringType())), *schema.fields])).json(path).filter(f"rows IS NULL AND `{vector}` IS NOT NULL")
    return listed.select(*names).unionByName(lines.select(*names))


def coded_vector(values: Sequence[float]) -> str:
    """A vector as half-precision floats, compressed, in base 64."""
    return base64.b64encode(zlib.compress(np.asarray(values, np.float16).tobytes())).decode()


def vector_codes(column: Column | str) -> Column:
    """coded_vector() of a column of arrays."""

    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else coded_vector(v))

    return F.pandas_udf(run, "string")(column)


def decoded_vectors(column: Column | str) -> Column:
    """The vectors of coded ones, with the precision that coding left; null for what isn't one."""

    def one(code: str | None) -> list | None:
        try:
            return None if code is None else np.frombuffer(zlib.decompress(base64.b64decode(code)), np.float16).astype(np.float32).tolist()
        except (ValueError, zlib.error):
            return None

    def run(codes: pd.Series) -> pd.Series:
        return codes.map(one)

    return F.pandas_udf(run, "array<float>")(column)


def read_vector_file(spark: SparkSession, path: str, fields: Sequence[str] = ()) -> DataFrame:
    """id, fields and vector of a vector file: an object with the list data (of __id__ and fields) and the rows of a matrix in base 64.

    The rows are taken from the matrix, else from each row's coded vector.
    """
    item = ", ".join(["__id__ string", *(f"`{f}` string" for f in fields), "vector string"])
    whole = f"embedding_dim int, matrix string, data array<struct<{', '.join(p.replace(' ', ':', 1) for p in item.split(', '))}>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", whole).alias("v"))
    rows = text.select("v.embedding_dim", "v.matrix", F.posexplode("v.data").alias("pos", "d")).select("embedding_dim", "pos", "d.*", "matrix")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, code = None, None
        for b in batches:
            out = []
            for dim, pos, vector, m in zip(b["embedding_dim"], b["pos"], b["vector"], b["matrix"]):
                if m and m != code:
                    matrix, code = np.frombuffer(base64.b64decode(m), np.float32), m
                if m and len(matrix) >= (pos + 1) * dim:
                    out.append(matrix[pos * dim : (pos + 1) * dim].tolist())
                else:
                    out.append(np.frombuffer(zlib.decompress(base64.b64decode(vector)), np.float16).astype(np.float32).tolist() if vector else None)
            yield pd.DataFrame({"id": b["__id__"], **{f: b[f] for f in fields}, "vector": out})

    return rows.mapInPandas(run, ", ".join(["id string", *(f"`{f}` string" for f in fields), "vector array<float>"]))


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, strings without control characters."""
    df.select(*[without_control(c).alias(c) if k == "string" else F.col(c) for c, k in df.dtypes]).write.json(path)


def write_kv_json(df: DataFrame, path: str, key: str = "id") -> None:
    """A JSON object a line that maps the key to the other columns; readable line by line."""
    rest = [c for c in df.columns if c != key]
    df.select(F.to_json(F.map_from_arrays(F.array(key), F.array(F.struct(*rest)))).alias("value")).write.text(path)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes (label, data) and edges (src, tgt, data) as GraphML: two folders of whole documents, one a task."""
    data = F.transform(F.map_entries("data"), lambda e: F.struct(e.key.alias("_key"), e.value.alias("_VALUE"))).alias("data")
    for name, df in (("node", nodes.select(F.col("label").alias("_id"), data)), ("edge", edges.select(F.col("src").alias("_source"), F.col("tgt").alias("_target"), data))):
        df.write.format("xml").option("rootTag", "graphml").option("rowTag", name).save(f"{path}/{name}s")


EXCEL_ROWS = 1_048_575


def write_excel(tables: dict[str, DataFrame], path: str) -> None:
    """Tables as the sheets of one workbook on this machine, rows streamed; more rows than a sheet holds are an error."""
    for name, df in tables.items():
        if df.limit(EXCEL_ROWS + 1).count() > EXCEL_ROWS:
            raise ValueError(f"{name} has more rows than a sheet holds")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        sheets = list(enumerate(tables.items(), 1))
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i, _ in sheets)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                   f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in sheets) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in sheets) + "</Relationships>")
        for i, (_, df) in sheets:
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as out:
                out.write(f"<worksheet {ns}><sheetData>".encode())
                flat = df.select(*[without_control(F.to_json(c) if k.startswith(("array", "map", "struct")) else F.col(c).cast("string")).alias(c) for c, k in df.dtypes])
                out.write(_excel_row(tuple(df.columns)))
                for row in flat.toLocalIterator(prefetchPartitions=True):
                    out.write(_excel_row(tuple(row)))
                out.write(b"</sheetData></worksheet>")


def _excel_row(row: tuple) -> bytes:
    return ("<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v or "")}</t></is></c>' for v in row) + "</row>").encode()


def parse_pdfs(paths: DataFrame, command: str, timeout: float = 1800) -> DataFrame:
    """path, content_list (the parser's JSON) and error of documents (path), by an outer program a document.

    command has {path} and {out}, a folder in which the program leaves a file that ends with
    _content_list.json. A program that fails or takes longer than timeout seconds is killed
    and gives an error, not an exception, so that others go on.
    """

    def one(path: str) -> tuple[str | None, str | None]:
        with tempfile.TemporaryDirectory() as out:
            local = path.removeprefix("file:").replace("//", "/", 1) if path.startswith("file:") else path
            args = [a.format(path=local, out=out) for a in shlex.split(command)]
            try:
                done = subprocess.run(args, capture_output=True, timeout=timeout, text=True)
            except subprocess.TimeoutExpired:
                return None, f"no result after {timeout:g} seconds"
            except OSError as e:
                return None, str(e)
            if done.returncode:
                return None, (done.stderr or f"ended with {done.returncode}")[-500:]
            found = sorted(os.path.join(d, f) for d, _, fs in os.walk(out) for f in fs if f.endswith("_content_list.json"))
            if not found:
                return None, "the program left no content list"
            with open(found[0], encoding="utf-8", errors="replace") as f:
                return f.read(), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = [one(p) for p in rows["path"]]
            yield pd.DataFrame({"path": rows["path"], "content_list": [a for a, _ in got], "error": [b for _, b in got]})

    reachable(paths.sparkSession)
    return paths.select("path").mapInPandas(run, "path string, content_list string, error string")


ITEM = "array<struct<type:string,text:string,table_body:string,img_path:string,page_idx:int>>"


def pages_of_lists(parsed: DataFrame) -> DataFrame:
    """path and pages of parsed documents (path, content_list): per page the texts and tables in order, and the images."""
    items = parsed.select("path", F.posexplode(F.from_json("content_list", ITEM)).alias("n", "i")).select("path", "n", "i.*").filter("page_idx IS NOT NULL")
    part = F.when(F.col("type") == "table", F.col("table_body")).otherwise(F.col("text"))
    pages = items.groupBy("path", "page_idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct("n", part.alias("t"))))), lambda x: x.t), "\n").alias("content"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("img_path").isNotNull(), F.struct("n", "img_path")))), lambda x: x.img_path).alias("images"),
    )
    page = F.struct((F.col("page_idx") + 1).alias("page_number"), "content", "images")
    return pages.groupBy("path").agg(F.array_sort(F.collect_list(page)).alias("pages"))


# Kinds of stores, what each can keep, and the settings each needs.
STORES = {
    "parquet": (("kv", "vector", "graph", "status"), ()), "json": (("kv", "vector", "status"), ()), "graphml": (("graph",), ()),
    "jdbc": (("kv", "vector", "graph", "status"), ("JDBC_URL",)), "graph_lines": (("graph",), ()), "graph_database": (("graph",), ("GRAPH_URL",)), "collection": (("vector",), ()),
}


def checked_store(kind: str, role: str, env: dict[str, str]) -> str:
    """The kind, if it is known, can keep the role and has its settings; else an error that says what is missing."""
    if kind not in STORES:
        raise ValueError(f"unknown store {kind}; there are {', '.join(STORES)}")
    roles, needed = STORES[kind]
    if role not in roles:
        raise ValueError(f"{kind} keeps no {role}")
    missing = [n for n in needed if not env.get(n)]
    if missing:
        raise ValueError(f"{kind} needs {', '.join(missing)}")
    return kind

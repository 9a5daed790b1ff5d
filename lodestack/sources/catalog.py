"""Versioned Parquet tables: writes go to new folders, one manifest rename commits them together."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.operators.graph import both_ways
from lodestack.sources import stores

NAMESPACES = (
    "full_docs", "text_chunks", "llm_response_cache", "full_entities", "full_relations", "entity_chunks", "relation_chunks",
    "vdb_entities", "vdb_relationships", "vdb_chunks", "nodes", "edges", "doc_status", "history",
)
MOST_MESSAGES, KEPT_MESSAGES = 10_000, 5_000


class Conflict(RuntimeError):
    """Another writer committed since this one began."""


class Catalog:
    """Logical tables below a root folder, one subfolder a workspace.

    A table is a list of folders. append() adds one, commit() replaces all of them. Manifests
    are numbered; writing a number that exists fails, so of two writers that began with the
    same state one gets a Conflict.
    """

    def __init__(self, spark: SparkSession, root: str, workspace: str = "default"):
        self.spark, self.root = spark, f"{root.rstrip('/')}/{workspace}"
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def version(self) -> int:
        """The number of the last manifest, 0 if there is none."""
        folder = self._path("manifests")
        if not self._fs().exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs().listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        """Table name to the folders of its current state."""
        version = self.version() if version is None else version
        if not version:
            return {}
        text = self._read_text(self._path("manifests", f"{version:010d}.json"))
        return json.loads(text)

    def _read_text(self, path) -> str:
        stream = self._fs().open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path, text: str, overwrite: bool) -> None:
        out = self._fs().create(path, overwrite)
        out.write(text.encode())
        out.close()

    def read(self, name: str) -> DataFrame | None:
        folders = self.manifest().get(name)
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else None

    def read_latest(self, name: str, keys: Sequence[str], order: str = "seq") -> DataFrame | None:
        """The last row of each key of a table that is only added to."""
        df = self.read(name)
        if df is None:
            return None
        last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
        return df.withColumn("__n", last).filter("__n = 1").drop("__n")

    def commit(self, tables: dict[str, DataFrame | None], added: dict[str, DataFrame] | None = None, since: int | None = None) -> int:
        """Write all tables, then make them valid at once: `tables` replace, `added` are added; None drops a table.

        A failure before the end changes nothing. since is the version the tables were made
        from, the current one if not given.
        """
        added = added or {}
        unknown = (set(tables) | set(added)) - set(NAMESPACES)
        if unknown:
            raise ValueError(f"unknown tables {sorted(unknown)}")
        base = self.version() if since is None else since
        new = self.manifest(base)
        for name, df in [*tables.items(), *added.items()]:
            if df is None:
                new.pop(name, None)
                continue
            folder = f"{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{folder}")
            new[name] = [*new.get(name, []), folder] if name in added else [folder]
        draft, final = self._path(f"draft-{uuid.uuid4().hex}.json"), self._path("manifests", f"{base + 1:010d}.json")
        self._put(draft, json.dumps(new), True)
        self._fs().mkdirs(final.getParent())
        uri = draft.toUri()
        context = self._jvm.org.apache.hadoop.fs.FileContext
        context = context.getFileContext(uri, self._conf) if uri.getScheme() else context.getFileContext(self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, final, none)
        except Exception as e:
            self._fs().delete(draft, False)
            if self._fs().exists(final):
                raise Conflict(f"another writer committed version {base + 1}") from e
            raise
        return base + 1

    def append(self, tables: dict[str, DataFrame], since: int | None = None) -> int:
        return self.commit({}, tables, since)

    def compact(self, name: str, keys: Sequence[str], order: str = "seq") -> None:
        """One folder with the last row of each key in place of all folders of a table."""
        df = self.read_latest(name, keys, order)
        if df is not None:
            self.commit({name: df})

    def drop(self, name: str) -> None:
        """Drop a table and remove its folders."""
        folders = self.manifest().get(name, [])
        self.commit({name: None})
        for f in folders:
            self._fs().delete(self._path(f), True)

    def vacuum(self, keep: int = 5) -> int:
        """Remove manifests but the last `keep`, and folders that none of these names; how many folders went."""
        last = self.version()
        used = {f for v in range(max(1, last - keep + 1), last + 1) for fs in self.manifest(v).values() for f in fs}
        gone = 0
        for name in NAMESPACES:
            if self._fs().exists(self._path(name)):
                for s in self._fs().listStatus(self._path(name)):
                    if f"{name}/{s.getPath().getName()}" not in used:
                        self._fs().delete(s.getPath(), True)
                        gone += 1
        for v in range(1, last - keep + 1):
            self._fs().delete(self._path("manifests", f"{v:010d}.json"), False)
        return gone

    def flag(self, name: str, on: bool) -> None:
        """Set or clear a mark that all runs over this catalog see."""
        path = self._path(f"flag-{name}")
        if on:
            self._put(path, "", True)
        else:
            self._fs().delete(path, False)

    def flagged(self, name: str) -> bool:
        return self._fs().exists(self._path(f"flag-{name}"))

    def say(self, message: str) -> None:
        """Add a line to the history; above MOST_MESSAGES lines the last KEPT_MESSAGES stay."""
        path = self._path("history.json")
        lines = json.loads(self._read_text(path)) if self._fs().exists(path) else []
        lines.append(message)
        if len(lines) > MOST_MESSAGES:
            lines = lines[-KEPT_MESSAGES:]
        self._put(path, json.dumps(lines), True)

    def history(self) -> list[str]:
        path = self._path("history.json")
        return json.loads(self._read_text(path)) if self._fs().exists(path) else []


def export(nodes: DataFrame, edges: DataFrame, path: str, kind: str = "csv", vectors: DataFrame | None = None) -> None:
    """Nodes and edges, each edge from either end, and relation vectors if given, as csv, json, md, txt or excel."""
    tables = {"entities": nodes, "relations": both_ways(edges), **({"relation_vectors": vectors} if vectors is not None else {})}
    if kind == "excel":
        stores.write_excel(tables, path)
        return
    for name, df in tables.items():
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
        if kind == "csv":
            flat.write.option("header", True).csv(f"{path}/{name}")
        elif kind == "json":
            flat.write.json(f"{path}/{name}")
        elif kind in ("md", "txt"):
            cells = F.concat_ws(" | " if kind == "md" else "\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in flat.columns])
            line = F.concat(F.lit("| "), cells, F.lit(" |")) if kind == "md" else cells
            flat.select(line.alias("value")).write.text(f"{path}/{name}")
        else:
            raise ValueError("kind must be csv, json, md, txt or excel")

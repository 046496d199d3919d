"""The stored graph: nodes in buckets by id, edges by source, a manifest, and what a refresh keeps of every file."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph import model as M
from weftgraph.operators import search
from weftgraph.sources.bucketed import Change, Tables
from weftgraph.sources.text_index import TextIndex

#: What text indexes cover.
FIELDS = ("label", "lexical")
_S, _MORE = T.StringType(), ("label_lower", "fqn_lower", "language", "framework")
_REPORT = [T.StructField("path", _S), T.StructField("content_hash", _S), T.StructField("seq", T.LongType())]


def _plus(front: list[T.StructField], back: T.StructType) -> T.StructType:
    return T.StructType([*front, *back.fields])


#: Columns and key of each table. Beside the graph, what refreshing needs: texts, reports and where each file's are, facts that
#: linkers work on by group, build files, and every claim to an edge.
TABLES = {
    "nodes": (T.StructType([*M.NODES.fields, *(T.StructField(x, _S) for x in _MORE)]), "id"),
    "edges": (M.EDGES, "src"),
    "files": ("path string, language string, content string, content_hash string", "path"),
    "raw_nodes": (_plus(_REPORT, M.NODES), "id"),
    "raw_edges": (_plus(_REPORT, M.EDGES), "src"),
    "reported": ("path string, id string", "path"),
    "tied": ("path string, src string, dst string, kind string", "path"),
    "into": ("path string, src string, dst string, kind string", "dst"),
    "calls": ("path string, src string, name string", "path"),
    "builds": ("dir string, file string, build_tool string, place int, name string", "dir"),
    "facts": ("linker string, group string, role string, id string, origin string", "group"),
    "claims": (_plus([T.StructField("rank", T.IntegerType()), T.StructField("group", _S)], M.EDGES), "src"),
}


def stored_columns(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the columns that searches and filters read, lines only where they are known."""
    line = lambda c: F.when(F.col(c) > 0, F.col(c)).alias(c)
    return nodes.select(*(line(f.name) if f.name in ("line_start", "line_end") else F.col(f.name) for f in M.NODES), F.lower("label").alias("label_lower"), F.lower("fqn").alias("fqn_lower"), M.prop("language").alias("language"), M.prop("framework").alias("framework"))


class GraphStore:
    """Every change makes new files of the buckets that it touches and then points to them, so readers always see a whole graph."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 8):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = Tables(spark, self.root, TABLES, buckets)

    def manifest(self) -> str:
        return self.tables.state()["note"].get("manifest", "")

    def built_at(self) -> str:
        """When the graph was last written (UTC, ISO 8601); '' before that."""
        return self.tables.state()["note"].get("built_at", "")

    def fresh(self, manifest: str) -> bool:
        """Whether the stored graph already is the one of this manifest."""
        return manifest != "" and manifest == self.manifest()

    def begin(self) -> Change:
        return self.tables.begin()

    def write(self, nodes: DataFrame, edges: DataFrame, manifest: str = "") -> None:
        """Store a whole graph; a ValueError if an id stands for two nodes. What refreshing needs isn't known of it."""
        twice = nodes.groupBy("id").count().filter("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"two nodes have the id {twice[0]['id']}")
        change = self.begin()
        change.new = {}
        change.put("nodes", None, stored_columns(nodes))
        change.put("edges", None, edges)
        commit(change, manifest, whole=True)

    def nodes(self) -> DataFrame:
        return self.begin().then("nodes")

    def edges(self) -> DataFrame:
        return self.begin().then("edges")

    def index(self, fields: str) -> TextIndex:
        """The stored index over nodes' labels ("label") or their prose ("lexical"); a refresh keeps up those that were built."""
        return TextIndex(self.spark, f"{self.root}/text-{fields}", self.tables.buckets)

    def build_indexes(self) -> None:
        for fields in FIELDS:
            if not self.index(fields).exists():
                self.index(fields).update(search.node_text(self.nodes(), fields).withColumnRenamed("id", "key"))

    def reset(self) -> None:
        """An empty graph, which can be refreshed."""
        change = self.begin()
        change.new = {}
        commit(change, "")


def commit(change: Change, manifest: str, whole: bool = False, refreshed: bool = False) -> None:
    now = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
    change.commit(manifest=manifest, whole=whole, refreshed=refreshed, built_at=now)


def without_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes of ``paths`` (path), and without edges at either end of these."""
    gone = nodes.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti").select(*nodes.columns), left.select(*edges.columns)


def without_sources(nodes: DataFrame, edges: DataFrame, sources: list[str]) -> tuple[DataFrame, DataFrame]:
    keep = ~F.coalesce(F.col("source").isin(sources), F.lit(False))
    return nodes.filter(keep), edges.filter(keep)

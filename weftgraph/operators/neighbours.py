"""Lookups, pages, neighbours, dead code and dangling edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph import model as M
from weftgraph.operators.settle import merged, paired, settled


def find_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return M.compact(nodes.filter(F.col("id") == node_id)).limit(1)


def find_by_kind(nodes: DataFrame, kind: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page in order of ids; negative numbers count as 0."""
    return M.compact(nodes.filter(F.col("kind") == kind)).orderBy("id").offset(max(0, offset)).limit(max(0, limit))


def find_preset(nodes: DataFrame, preset: str, offset: int = 0, limit: int = 100) -> DataFrame:
    return find_by_kind(nodes, M.PRESETS[preset], offset, limit).select("id", "label")


def query_edges(edges: DataFrame, kind: str | None = None, limit: int = 50) -> DataFrame:
    """(source, target, kind), kinds compared whatever their case."""
    e = edges if not kind else edges.filter(F.lower("kind") == kind.lower())
    return e.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.upper("kind").alias("kind")).orderBy("source", "kind", "target").limit(M.cap_results(limit))


def limited(rows: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The first ``most`` rows (1 at least) and whether there were more. The input runs once: one row more is kept."""
    most = max(1, most)
    kept = settled(rows.limit(most + 1))
    return kept.limit(most), kept.count() > most


def incoming(nodes: DataFrame, edges: DataFrame, node_id: str, kinds: list[str] | None = None) -> DataFrame:
    """Distinct sources of edges to a node, in order of ids."""
    e = edges.filter(F.col("dst") == node_id)
    e = e.filter(F.col("kind").isin(kinds)) if kinds else e
    return M.compact(nodes.join(paired(settled(e.select(F.col("src").alias("id")).distinct())), "id", "left_semi")).orderBy("id")


def outgoing(nodes: DataFrame, edges: DataFrame, node_id: str, kinds: list[str] | None = None) -> DataFrame:
    e = edges.filter(F.col("src") == node_id)
    e = e.filter(F.col("kind").isin(kinds)) if kinds else e
    return M.compact(nodes.join(paired(settled(e.select(F.col("dst").alias("id")).distinct())), "id", "left_semi")).orderBy("id")


def consumers(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    return incoming(nodes, edges, node_id, ["consumes", "listens"])


def producers(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    return incoming(nodes, edges, node_id, ["produces", "publishes"])


def callers(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    return incoming(nodes, edges, node_id, ["calls"])


def dependencies(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    return outgoing(nodes, edges, node_id, ["depends_on"])


def dependents(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    return incoming(nodes, edges, node_id, ["depends_on"])


def dead_code(nodes: DataFrame, edges: DataFrame, kinds: list[str] | None = None, limit: int | None = 100) -> DataFrame:
    """Nodes of the given kinds, entry points aside, that no edge of use points to."""
    used = edges.filter(F.col("kind").isin(M.SEMANTIC_KINDS)).select(F.col("dst").alias("id"))
    out = nodes.filter(F.col("kind").isin(kinds or M.DEAD_CODE_KINDS) & ~F.col("kind").isin(M.ENTRY_POINT_KINDS)).join(used, "id", "left_anti")
    out = M.compact(out).orderBy("id")
    return out if limit is None else out.limit(limit)


def drop_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    # What moves are the ends, each once, and not the edges.
    gone = paired(settled(edges.select(F.col("src").alias("id")).distinct().unionByName(edges.select(F.col("dst").alias("id")).distinct()).distinct().join(merged(nodes.select("id")), "id", "left_anti")))
    whole = edges.filter("src IS NOT NULL AND dst IS NOT NULL")
    return whole.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns)


def membership(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(service_id, service, node_id): what each service contains."""
    s = nodes.filter(F.col("kind") == "service").select(F.col("id").alias("service_id"), F.col("label").alias("service"))
    return edges.filter(F.col("kind") == "contains").join(s, F.col("src") == F.col("service_id")).select("service_id", "service", F.col("dst").alias("node_id"))


def component_by_file(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Nodes of a file with the (alphabetically first) service that contains each."""
    own = membership(nodes, edges).groupBy("node_id").agg(F.min("service").alias("service"))
    return M.compact(nodes.filter(F.col("file_path") == path)).join(own, F.col("id") == F.col("node_id"), "left").drop("node_id").orderBy("id")


def matching(identifier: str) -> Column:
    return (F.col("file_path") == identifier) | (F.col("label") == identifier) | (F.col("id") == identifier) | (F.col("fqn") == identifier)


def related_endpoints(nodes: DataFrame, edges: DataFrame, identifier: str, limit: int = 50) -> DataFrame:
    """Endpoints of the services that contain what the identifier names."""
    own = membership(nodes, edges)
    hit = nodes.filter(matching(identifier)).select(F.col("id").alias("node_id"))
    services = own.join(hit, "node_id", "left_semi").select("service_id").distinct()
    near = own.join(services, "service_id", "left_semi").select(F.col("node_id").alias("id"))
    return M.compact(nodes.filter(F.col("kind").isin("endpoint", "websocket_endpoint")).join(near, "id", "left_semi")).orderBy("id").limit(limit)


def evidence_text(nodes: DataFrame, edges: DataFrame, path: str, most_nodes: int = 25, most_upstream: int = 15) -> DataFrame:
    """One row for a file: its nodes and what points to them, as lines of text."""
    own = settled(nodes.filter(F.col("file_path") == path).orderBy("id").limit(most_nodes))
    up = nodes.join(edges.join(own.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")), "id", "left_semi").orderBy("id").limit(most_upstream)
    line = lambda mark: F.concat(F.lit(mark), F.col("kind"), F.lit(" "), F.col("label"), F.lit(" ("), F.col("id"), F.lit(")"))
    rows = own.select(F.lit(0).alias("part"), "id", line("- ").alias("line")).unionByName(up.select(F.lit(1).alias("part"), "id", line("< ").alias("line")))
    return rows.agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("part", "id", "line"))), lambda r: r["line"])).alias("text"))

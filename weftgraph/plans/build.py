"""From source files to a stored graph: detect, merge, link, classify, enrich."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import model as M
from weftgraph.detectors import engine
from weftgraph.operators import claims, enrich, layers, linkers, merge
from weftgraph.operators.neighbours import drop_dangling
from weftgraph.sources import files as S
from weftgraph.sources.graph_store import GraphStore

ARRIVAL = ["path", "content_hash", "seq"]


def index(spark: SparkSession, files: DataFrame, cache: S.Cache) -> dict[str, int]:
    """Run the detectors over files the cache lacks and forget those that are gone; how many of each."""
    known = cache.read("files")
    before = known.select("path", "content_hash") if known is not None else spark.createDataFrame([], "path string, content_hash string")
    delta = S.diff(before, files.select("path", "content_hash"))
    new = files.join(delta.filter("status IN ('added', 'modified')"), "path", "left_semi")
    counts = {r["status"]: r["n"] for r in delta.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts.get("added") or counts.get("modified"):
        found = engine.detect(new)
        cache.put(new.select("path", "language", "content_hash"), engine.raw_nodes(found), engine.raw_edges(found))
    if counts.get("deleted"):
        cache.purge(before.join(files.select("path"), "path", "left_anti"))
    return counts


def assemble(raw_nodes: DataFrame, raw_edges: DataFrame, files: DataFrame, project: str = "root") -> tuple[DataFrame, DataFrame]:
    """The whole graph from detector output and the files' texts."""
    nodes = merge.merge_nodes(raw_nodes, ARRIVAL)
    edges = drop_dangling(nodes, merge.merge_edges(raw_edges, ARRIVAL))
    found = [edges, linkers.link_topics(nodes, edges), linkers.link_entities(nodes, edges)]
    modules, contains = linkers.link_modules(nodes, edges)
    nodes = layers.classify(nodes.unionByName(modules))
    nodes = enrich.with_types(enrich.with_comments(enrich.with_config_keys(nodes), files), files)
    found += [contains, linkers.resolve_calls(enrich.extract_calls(files, nodes), nodes)]
    nodes, services, owned = enrich.detect_services(nodes, files, project)
    edges = claims.survivors(claims.ranked(*found, owned))
    return nodes.unionByName(services).select(*(f.name for f in M.NODES)), edges


def build(spark: SparkSession, root: str, cache: S.Cache, store: GraphStore, project: str = "root", use_git: bool = True) -> bool:
    """Index the tree at ``root`` and store its graph; False where the stored graph is that of the same files."""
    files = S.read_files(spark, root, use_git)
    index(spark, files, cache)
    manifest = S.manifest_tree(files).first()["manifest"]
    if store.fresh(manifest):
        return False
    nodes, edges = assemble(cache.read("raw_nodes"), cache.read("raw_edges"), files, project)
    store.write(nodes, edges, manifest)
    return True

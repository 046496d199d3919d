"""Services and what connects them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import model as M
from weftgraph.operators import traversal
from weftgraph.operators.neighbours import membership
from weftgraph.operators.settle import merged, settled


def connections(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (source, target, kind) of runtime edges between nodes of different services, by label."""
    own = membership(nodes, edges)
    a = own.select(F.col("node_id").alias("src"), F.col("service_id").alias("a_id"), F.col("service").alias("source"))
    b = own.select(F.col("node_id").alias("dst"), F.col("service_id").alias("b_id"), F.col("service").alias("target"))
    e = edges.filter(F.col("kind").isin(M.RUNTIME_KINDS)).select("src", "dst", "kind")
    return e.join(a, "src").join(b, "dst").filter("a_id <> b_id").select("source", "target", "kind").distinct()


def services(nodes: DataFrame) -> DataFrame:
    number = lambda x: F.coalesce(M.prop(x).try_cast("long"), F.lit(0).cast("long")).alias(x)
    return nodes.filter(F.col("kind") == "service").select("id", "label", F.coalesce(M.prop("build_tool"), F.lit("unknown")).alias("build_tool"), number("endpoint_count"), number("entity_count"))


def degrees(links: DataFrame) -> DataFrame:
    ends = links.select(F.col("source").alias("label"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(links.select(F.col("target").alias("label"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("label").agg(F.sum("o").alias("connections_out"), F.sum("i").alias("connections_in"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each service with its counts and degrees, each distinct connection counting once."""
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return services(nodes).join(degrees(connections(nodes, edges)), "label", "left").select("label", "build_tool", "endpoint_count", "entity_count", zero("connections_out"), zero("connections_in"))


def bottlenecks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees(connections(nodes, edges))
    return d.select(F.col("label").alias("service"), "connections_in", "connections_out", (F.col("connections_in") + F.col("connections_out")).alias("total")).orderBy(F.desc("total"), "service")


def dead_services(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    hit = connections(nodes, edges).select(F.col("target").alias("label"))
    return services(nodes).join(hit, "label", "left_anti").select("id", "label").orderBy("label")


def service_links(nodes: DataFrame, edges: DataFrame, label: str, outgoing: bool = True) -> DataFrame:
    own, peer = ("source", "target") if outgoing else ("target", "source")
    return connections(nodes, edges).filter(F.col(own) == label).select(F.col(peer).alias("service"), "kind").orderBy("service", "kind")


def service_peers(nodes: DataFrame, edges: DataFrame, label: str, outgoing: bool = True) -> DataFrame:
    return service_links(nodes, edges, label, outgoing).select("service").distinct().orderBy("service")


def service_detail(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """What a service contains, in five buckets."""
    bucket = F.when(F.col("kind") == "endpoint", "endpoints").when(F.col("kind") == "entity", "entities").when(F.col("kind") == "guard", "guards").when(F.col("kind") == "database_connection", "databases").when(F.col("kind").isin("topic", "queue", "message_queue"), "queues")
    own = membership(nodes, edges).filter(F.col("service") == label).select(F.col("node_id").alias("id"))
    return M.compact(nodes.join(own, "id", "left_semi")).withColumn("bucket", bucket).filter("bucket IS NOT NULL").orderBy("bucket", "id")


def counts_by_service(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    own = membership(nodes, edges).join(merged(nodes.select(F.col("id").alias("node_id"), "kind")), "node_id")
    return own.groupBy("service").agg(F.count_if(F.col("kind") == "endpoint").alias("endpoint_count"), F.count_if(F.col("kind") == "entity").alias("entity_count"))


def service_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, kind): pairs of connected services by label, with the first kind of connection."""
    return connections(nodes, edges).groupBy(F.col("source").alias("src"), F.col("target").alias("dst")).agg(F.min("kind").alias("kind"))


def service_path_rows(nodes: DataFrame, edges: DataFrame, start: str, goal: str) -> DataFrame:
    """(hop, source, target, kind) of a shortest path between services, the smallest names winning; no rows from one to
    itself or where there is none."""
    pairs = settled(service_pairs(nodes, edges))
    labels = services(nodes).select(F.col("label").alias("id"))
    path = traversal.shortest_path(labels, pairs, start, goal)
    hops = [(i, a, b) for i, (a, b) in enumerate(zip(path, path[1:], strict=False), 1)]
    steps = nodes.sparkSession.createDataFrame(hops, "hop int, source string, target string")
    return steps.join(pairs, (F.col("source") == F.col("src")) & (F.col("target") == F.col("dst"))).select("hop", "source", "target", "kind").orderBy("hop")


def service_path(nodes: DataFrame, edges: DataFrame, start: str, goal: str) -> list[dict] | None:
    """Hops of a shortest path between services; [] from one to itself, None where there is none."""
    if start == goal:
        return []
    return [{"from": r["source"], "to": r["target"], "type": r["kind"]} for r in service_path_rows(nodes, edges, start, goal).collect()] or None


def service_cycles(nodes: DataFrame, edges: DataFrame, longest: int = 10, limit: int = 100) -> list[list[str]]:
    """The cycles of ``service_cycle_rows`` as lists, not closed."""
    return [r["cycle"].split(">")[:-1] for r in service_cycle_rows(nodes, edges, longest, limit).collect()]


def service_cycle_rows(nodes: DataFrame, edges: DataFrame, longest: int = 10, limit: int = 100) -> DataFrame:
    """(cycle, length): cycles of services, the shortest first, each from its smallest name on and closed by it. A walk
    in order of names would find some of them; this lists all, up to the limit."""
    found = traversal.cycles(settled(service_pairs(nodes, edges)), longest, limit)
    return found.select(F.concat_ws(">", F.concat("path", F.slice("path", 1, 1))).alias("cycle"), F.size("path").alias("length"))

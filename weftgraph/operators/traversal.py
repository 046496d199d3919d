"""Paths, reachability, components and cycles: frontiers grow by hops along stored edges, visited nodes drop out by anti joins.

Every function takes edges as a table (src, dst, kind) or as an ``Adjacency``, along which a hop doesn't move them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import model as M
from weftgraph.operators.neighbours import membership
from weftgraph.operators.settle import merged, paired, settled, written
from weftgraph.sources.adjacency import NAMED, Adjacency, neighbours


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _names(front: DataFrame) -> tuple[int, list[str] | None]:
    """How many ids there are, and which, if few."""
    some = [r["id"] for r in front.select("id").limit(NAMED + 1).collect()]
    return len(some), some if len(some) <= NAMED else None


def reachable(edges: DataFrame | Adjacency, start: str, depth: int, kinds: list[str] | None = None, both_ways: bool = False, include_start: bool = False) -> DataFrame:
    """(id, hops) of nodes within 1 to ``depth`` hops. Each hop's nodes are written once and kept as they are."""
    spark: SparkSession = edges.spark if isinstance(edges, Adjacency) else edges.sparkSession
    front, names = spark.range(1).select(F.lit(start).alias("id"), F.lit(0).alias("hops")), [start]
    seen = [front.limit(0) if include_start else front]
    for hop in range(1, depth + 1):
        met = neighbours(edges, front, names, kinds=kinds)
        met = met.unionByName(neighbours(edges, front, names, True, kinds)) if both_ways else met
        front = settled(met.select(F.col("to").alias("id")).distinct().join(_union(seen).select("id"), "id", "left_anti").withColumn("hops", F.lit(hop)))
        n, names = _names(front)
        if not n:
            break
        seen.append(front)
    return _union(seen).filter("hops > 0")


def blast_radius(nodes: DataFrame, edges: DataFrame | Adjacency, start: str, depth: int = 5, kinds: list[str] | None = None, include_start: bool = False) -> DataFrame:
    """Nodes that ``start`` reaches, with the hops to each; over every kind of edge unless ``kinds`` says otherwise."""
    return M.compact(nodes).join(paired(reachable(edges, start, M.cap_depth(depth if depth > 0 else 5), kinds, include_start=include_start)), "id").orderBy("id")


def reach_of_each(nodes: DataFrame, edges: DataFrame | Adjacency, starts: DataFrame, depth: int = 3, kinds: list[str] | None = None) -> DataFrame:
    """(start, n): how many nodes each of ``starts`` (id) reaches within ``depth`` hops, itself aside, all starts at once."""
    front = starts.select(F.col("id").alias("start"), "id").distinct()
    seen = [front]
    for _ in range(M.cap_depth(depth)):
        # A pair (start, node) is met once, however many ways lead there.
        step = neighbours(edges, front.select("id").distinct(), kinds=kinds)
        front = settled(front.join(step, F.col("id") == F.col("from")).select("start", F.col("to").alias("id")).distinct().join(_union(seen), ["start", "id"], "left_anti"))
        if front.isEmpty():
            break
        seen.append(front)
    met = _union(seen).join(merged(nodes.select("id")), "id", "left_semi").filter("start <> id")
    return starts.select(F.col("id").alias("start")).distinct().join(met.groupBy("start").agg(F.count(F.lit(1)).alias("n")), "start", "left").fillna(0, ["n"])


def affected_services(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Labels of the services that contain any of ``ids`` (id)."""
    own = membership(nodes, edges).join(paired(settled(ids.select(F.col("id").alias("node_id")).distinct())), "node_id", "left_semi")
    return own.filter("service <> ''").select("service").distinct().orderBy("service")


def ego_graph(nodes: DataFrame, edges: DataFrame | Adjacency, center: str, radius: int = 2, limit: int = M.MAX_RESULTS) -> DataFrame:
    """Nodes within ``radius`` of ``center`` whichever way edges point, without it."""
    return M.compact(nodes).join(paired(reachable(edges, center, M.cap_depth(radius), both_ways=True)), "id").orderBy("id").limit(M.cap_results(limit))


def shortest_path(nodes: DataFrame, edges: DataFrame | Adjacency, start: str, goal: str, most: int = 20) -> list[str]:
    """Ids along a shortest directed path of at most ``most`` hops: the smallest parent wins. [] where there is none."""
    spark = nodes.sparkSession
    if nodes.filter(F.col("id").isin(start, goal)).select("id").distinct().count() < (1 if start == goal else 2):
        return []
    if start == goal:
        return [start]
    front, names = spark.range(1).select(F.lit(start).alias("id"), F.lit(None).cast("string").alias("parent")), [start]
    seen = [front]
    for _ in range(most):
        front = settled(neighbours(edges, front, names).groupBy(F.col("to").alias("id")).agg(F.min("from").alias("parent")).join(_union(seen).select("id"), "id", "left_anti"))
        if not front.filter(F.col("id") == goal).isEmpty():
            path = [goal]
            for hop in [front, *seen[:0:-1]]:  # back through the hops, one parent at each
                path.append(hop.filter(F.col("id") == path[-1]).first()["parent"])
            return path[::-1]
        n, names = _names(front)
        if not n:
            return []
        seen.append(front)
    return []


def _entered(edges: DataFrame, most: int) -> DataFrame:
    """Distinct (src, dst), loops aside, without edges that start where no path of up to ``most`` edges ends; those lie on no cycle.

    Round by round the ids that are entered from the last ones are written, not the edges: these only when half of the ids are gone
    since, and at the end. Edges in buckets by source don't move.
    """
    e, ids, n, at = edges.filter("src <> dst").select("src", "dst"), None, None, None
    for _ in range(most):
        out = e if ids is None else e.join(paired(ids), "src", "left_semi")
        if at and 2 * n <= at:
            e, ids, at = (out := written(out)), None, n
        now = written(out.select(F.col("dst").alias("src")).distinct())
        last, n, ids = n, now.count(), now
        at = at or n
        if n in (0, last):
            break
    return written((e if ids is None else e.join(paired(ids), "src", "left_semi")).distinct())


def _trimmed(e: DataFrame, most: int) -> DataFrame:
    """``e`` without edges that can't lie on a cycle: ends that nothing enters, or that lead nowhere, go, round by round."""
    n = e.count()
    for _ in range(most):
        e = written(e.join(merged(e.select(F.col("dst").alias("src")).distinct()), "src", "left_semi").join(merged(e.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi").select("src", "dst"))
        left = e.count()
        if left == n:
            break
        n = left
    return e


def _spread(colours: DataFrame, e: DataFrame) -> DataFrame:
    """Every node's largest colour among its own and those of the nodes that lead to it along ``e``."""
    while True:
        got = e.join(merged(colours.select(F.col("id").alias("src"), "colour")), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("new"))
        after = settled(colours.join(merged(got), "id", "left").select("id", F.greatest("colour", "new").alias("colour"), (F.col("new") > F.col("colour")).alias("moved")))
        colours = after.select("id", "colour")
        if after.filter("moved").isEmpty():
            return colours


def components(edges: DataFrame, trim: int = 10) -> DataFrame:
    """(id, component) of the strongly connected components of two nodes or more; a component is named by its smallest id.

    Forward-backward colouring: what can't lie on a cycle is trimmed; then the largest id that leads to a node is its colour, and of
    the nodes of one colour those that lead back to the node which gave it are one component. They go, and the rest is coloured
    again. A round finds a component of each colour at once; its steps are as many as the longest shortest path is.
    """
    spark = edges.sparkSession
    found = [spark.createDataFrame([], "id string, root string")]
    e = _trimmed(_entered(edges, trim), trim)
    while not e.isEmpty():
        ids = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
        colours = _spread(ids.withColumn("colour", F.col("id")), e)
        a, b = colours.select(F.col("id").alias("src"), F.col("colour").alias("one")), colours.select(F.col("id").alias("dst"), F.col("colour").alias("two"))
        inside = settled(e.join(merged(a), "src").join(merged(b), "dst").filter("one = two").select("src", "dst", F.col("one").alias("colour")))
        # Backwards from each colour's own node.
        front = settled(colours.filter("id = colour").select("id", "colour"))
        met = [front]
        while not front.isEmpty():
            back = inside.join(merged(front.select(F.col("id").alias("dst"), "colour")), ["dst", "colour"]).select(F.col("src").alias("id"), "colour").distinct()
            front = settled(back.join(merged(_union(met)), ["id", "colour"], "left_anti"))
            met.append(front)
        whole = settled(_union(met).select("id", F.col("colour").alias("root")))
        found.append(whole)
        gone = whole.select("id")
        e = _trimmed(written(e.join(merged(gone.withColumnRenamed("id", "src")), "src", "left_anti").join(merged(gone.withColumnRenamed("id", "dst")), "dst", "left_anti").select("src", "dst")), trim)
    rows = _union(found)
    named = rows.groupBy("root").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(merged(named), "root").select("id", "component")


def cycles(edges: DataFrame | Adjacency, longest: int = 10, limit: int | None = 100) -> DataFrame:
    """Simple cycles of 2 to ``longest`` edges as arrays of ids, each once, from its smallest id on; the shortest come first.

    Paths grow within strongly connected components alone, and over ids above their first, so each cycle is met at one
    start and no path leaves for where it can't come back from. With a limit, longer cycles aren't looked for once there are
    as many. Without one, all are listed, of which a dense graph has exponentially many.
    """
    table = _entered(edges.out if isinstance(edges, Adjacency) else edges, 10)
    parts = settled(components(table))
    a, b = parts.select(F.col("id").alias("src"), F.col("component").alias("one")), parts.select(F.col("id").alias("dst"), F.col("component").alias("two"))
    e = settled(table.join(merged(a), "src").join(merged(b), "dst").filter("one = two").select("src", "dst"))
    paths = e.filter("dst > src").select(F.col("src").alias("first"), F.array("src", "dst").alias("path"))
    found, met = None, 0
    for _ in range(2, longest + 1):
        step = paths.join(merged(e), F.element_at("path", -1) == F.col("src"))
        closed = settled(step.filter("dst = first").select("path"))
        found = closed if found is None else found.unionByName(closed)
        met += closed.count()
        if limit is not None and met >= limit:
            break
        paths = settled(step.filter((F.col("dst") > F.col("first")) & ~F.array_contains("path", F.col("dst"))).select("first", F.concat("path", F.array("dst")).alias("path")))
        if paths.isEmpty():
            break
    out = found.orderBy(F.size("path"), F.concat_ws(">", "path"))
    return out if limit is None else out.limit(limit)

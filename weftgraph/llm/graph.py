"""Connected components of links that no one machine need hold."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K
from weftgraph.llm.storage import join_groups, materialize

#: Links that one task contracts, at most about.
TASK = 500_000


def _local_forest(batches):
    """Links of one task, replaced by links of each node to the least node it reaches within the task."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    rows = [(x, find(x)) for x in list(parent)]
    rows = [r for r in rows if r[0] != r[1]]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["u", "v"])


def _contracted(edges: DataFrame, n: int) -> DataFrame:
    """``edges`` (n rows) contracted in as few tasks as hold ``TASK`` of them each."""
    return edges.coalesce(max(1, -(-n // TASK))).mapInArrow(K.tidy(_local_forest), "u long, v long")


def _least(edges: DataFrame, total: int) -> DataFrame:
    """Each edge (u, v) with the least of u and u's partners, a hot u's edges staying where they are."""
    least = edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    return join_groups(edges, least, "u", "n", total)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (two long columns, no nulls) that isn't its component's least node.

    Links are first contracted within tasks of bounded size. If that takes more than one task, large-star and
    small-star rounds alternate until every node points to its root, each round contracted and written
    to the shared folder.
    """
    a, b = links.columns[:2]
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v"), "links")
    n = edges.count()
    tasks, state = -(-n // TASK), None
    edges = materialize(_contracted(edges, n), "links")
    while tasks > 1:
        n, mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, mark) == state:
            break
        state = (n, mark)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large, n)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v")
        edges = materialize(_contracted(small.distinct(), n).distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))

"""The whole graph as text: part files that, read in the order of their names, are one document of nodes, edges and stats.

Rows are range-partitioned by (section, key), so that parts follow one another; nothing but three numbers passes the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import model as M

FORMATS = ("json", "yaml")


def export_lines(nodes: DataFrame, edges: DataFrame, form: str = "json") -> DataFrame:
    """(section, key, line) whose lines in order of section and key are the document. A ValueError for an unknown format.

    Nodes stand in order of ids, edges in order of source, kind and target; fields without a value are left out.
    """
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}: expected {'|'.join(FORMATS)}")
    item = lambda fields: F.to_json(F.struct(*(f.name for f in fields)))
    n = nodes.select(F.col("id").alias("key"), item(M.NODES).alias("text"))
    e = edges.select(F.concat_ws("\u0001", "src", "kind", "dst", "id").alias("key"), item(M.EDGES).alias("text"))
    (n_nodes, first_node), (n_edges, first_edge) = (tuple(d.agg(F.count(F.lit(1)), F.min("key")).first()) for d in (n, e))
    stats = json.dumps({"node_count": n_nodes, "edge_count": n_edges})
    if form == "json":
        frame = [(0, "", '{"nodes": ['), (2, "", '], "edges": ['), (4, "", f'], "stats": {stats}}}')]
        line = lambda first: F.concat(F.when(F.col("key") == first, "").otherwise(","), "text")
    else:  # a list of flow mappings, which JSON objects are
        frame = [(0, "", "nodes:" if n_nodes else "nodes: []"), (2, "", "edges:" if n_edges else "edges: []"), (4, "", f"stats: {stats}")]
        line = lambda first: F.concat(F.lit("- "), "text")
    rows = nodes.sparkSession.createDataFrame(frame, "section int, key string, line string")
    for section, d, first in ((1, n, first_node), (3, e, first_edge)):
        rows = rows.unionByName(d.select(F.lit(section).alias("section"), "key", line(first).alias("line")))
    return rows


def write_export(nodes: DataFrame, edges: DataFrame, path: str, form: str = "json") -> None:
    """Write the document into the folder ``path``, which must not exist."""
    order = ["section", "key"]
    export_lines(nodes, edges, form).repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)

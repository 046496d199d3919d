"""The graph over a folder of tables, stored once for a session: nodes by kind, edges by both ends, and its text indexes."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import model as M
from weftgraph.operators import search
from weftgraph.operators.settle import shared_dir
from weftgraph.plans.tables import TABLES, edges_dealt, graph_from_tables, whole_edges
from weftgraph.sources.adjacency import Adjacency
from weftgraph.sources.text_index import TextIndex

#: Bytes of tables for each bucket of edges, and the fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 1 << 25, 8
_KNOWN: dict[tuple, StoredGraph | TextIndex] = {}


def _print(spark: SparkSession, paths: list[str]) -> tuple:
    """Path, length and time of every file of some tables: what is stored of them stands while these do."""
    out, conf = [], spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        out += [(str(x.getPath()), x.getLen(), x.getModificationTime()) for x in fs.listStatus(p) or ()]
    return tuple(sorted(out))


class StoredGraph:
    """``nodes``, ``edges`` (by source) and ``walks``, the adjacency that hops read; each written when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.root = f"{shared_dir(spark)}/weft/graph-{uuid.uuid4().hex}"

    @cached_property
    def nodes(self) -> DataFrame:
        nodes = graph_from_tables(self.spark, self.sf_dir)[0]
        # A part of the tables gives nodes of one kind: they are written where they are read, nothing is shuffled.
        nodes.sortWithinPartitions("kind", "id").write.option("compression", "zstd").partitionBy("kind").parquet(f"{self.root}/nodes")
        return self.spark.read.schema(nodes.schema).parquet(f"{self.root}/nodes").select(*(f.name for f in M.NODES))

    @cached_property
    def walks(self) -> Adjacency:
        buckets = max(LEAST_BUCKETS, sum(x[1] for x in _print(self.spark, [f"{self.sf_dir}/{t}.parquet" for t in TABLES])) // BUCKET_BYTES)
        return Adjacency.write_dealt(edges_dealt(self.spark, self.sf_dir, buckets), f"{self.root}/edges", buckets, whole_edges)

    @property
    def edges(self) -> DataFrame:
        return self.walks.out

    def index(self, fields: str) -> TextIndex:
        """The index over the nodes' labels or their prose, built when first asked for."""
        found = TextIndex(self.nodes.sparkSession, f"{self.root}/text-{fields}")
        if not found.exists():
            found.update(search.node_text(self.nodes, fields).withColumnRenamed("id", "key"))
        return found


def documents_index(spark: SparkSession, sf_dir: str, table: str, key: str, text: str) -> TextIndex:
    """The stored index over a table's texts, built when first asked for, and again when its files change."""
    name = (spark.sparkContext.applicationId, id(spark), sf_dir, table, key, text, _print(spark, [f"{sf_dir}/{table}.parquet"]))
    if name not in _KNOWN:
        _KNOWN[name] = TextIndex(spark, f"{shared_dir(spark)}/weft/text-{uuid.uuid4().hex}")
        _KNOWN[name].update(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")))
    return _KNOWN[name]


def stored_graph(spark: SparkSession, sf_dir: str) -> StoredGraph:
    """The stored graph of the tables in ``sf_dir``, written when first asked for, and again when a file of theirs changes."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, _print(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES]))
    if key not in _KNOWN:
        _KNOWN[key] = StoredGraph(spark, sf_dir)
    return _KNOWN[key]

"""Edges stored twice, in buckets by source and in buckets by target, each sorted within.

A hop from many nodes is then a join that moves these nodes alone: edges stay in the tasks that read their buckets. A hop from few
nodes reads only the buckets that can hold them. ``incoming`` and ``outgoing`` neighbours do the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import model as M

#: Nodes up to which a hop names them instead of joining.
NAMED = 200
STORED = ("src", "kind", "dst")


class Adjacency:
    def __init__(self, spark: SparkSession, root: str, buckets: int, whole: Callable[[DataFrame], DataFrame] | None = None):
        """The edges stored at ``root`` with that many buckets; with ``whole`` their src, kind and dst, of which it makes edges."""
        self.spark, self.root, self.buckets, self.whole = spark, root.rstrip("/"), buckets, whole

    def _table(self, by: str) -> DataFrame:
        name, columns = f"weft_{by}_{uuid.uuid4().hex}", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in M.EDGES if not self.whole or f.name in STORED)
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{by}'")
        return self.whole(self.spark.table(name)) if self.whole else self.spark.table(name)

    @cached_property
    def out(self) -> DataFrame:
        return self._table("src")

    @cached_property
    def into(self) -> DataFrame:
        if self.whole:  # stored when a walk first goes backwards
            _store(self.out.select(*STORED).repartition(self.buckets, "dst"), self.root, "dst", self.buckets)
        return self._table("dst")

    @staticmethod
    def write(edges: DataFrame, root: str, buckets: int | None = None) -> Adjacency:
        """Store ``edges``; as many buckets as the session has shuffle partitions, unless given."""
        spark, root = edges.sparkSession, root.rstrip("/")
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        for by in ("src", "dst"):
            # Dealt as the buckets are, so that each bucket is one file.
            _store(edges.select(*(f.name for f in M.EDGES)).repartition(buckets, by), root, by, buckets)
        return Adjacency(spark, root, buckets)

    @staticmethod
    def write_dealt(dealt: DataFrame, root: str, buckets: int, whole: Callable[[DataFrame], DataFrame]) -> Adjacency:
        """Store src, kind and dst, dealt to as many tasks by src already; by dst once it is needed."""
        _store(dealt.select(*STORED), root.rstrip("/"), "src", buckets)
        return Adjacency(dealt.sparkSession, root, buckets, whole)


def _store(dealt: DataFrame, root: str, by: str, buckets: int) -> None:
    dealt.write.option("path", f"{root}/{by}").option("compression", "zstd").bucketBy(buckets, by).sortBy(by).saveAsTable(f"weft_write_{uuid.uuid4().hex}")


def neighbours(edges: DataFrame | Adjacency, front: DataFrame, named: list[str] | None = None, back: bool = False, kinds: list[str] | None = None) -> DataFrame:
    """(from, to) along every edge of ``kinds`` out of the nodes of ``front`` (id), or into them if ``back``.

    ``named``: the same ids, if they are few and known.
    """
    table = edges if isinstance(edges, DataFrame) else edges.into if back else edges.out
    a, b = ("dst", "src") if back else ("src", "dst")
    table = table.filter(F.col("kind").isin(kinds)) if kinds else table
    if named is not None:
        return table.filter(F.col(a).isin(named)).select(F.col(a).alias("from"), F.col(b).alias("to"))
    return table.select("src", "dst").join(front.select(F.col("id").alias(a)), a).select(F.col(a).alias("from"), F.col(b).alias("to"))

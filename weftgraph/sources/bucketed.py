"""Parquet tables in buckets by a key, of which a change rewrites only those that it touches.

Each table is a folder of generations, each generation a folder for each bucket it wrote. One small file, written last, says
which generation every bucket of every table stands in: readers see a whole state, the one before or the one after a change.
Files that neither this state nor the one before points to are deleted.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """``schemas``: for each table its columns (a DDL text or a StructType) and the column that it is dealt by."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, tuple], buckets: int = 16):
        self.spark, self.root, self.schemas, self.buckets = spark, root.rstrip("/"), schemas, buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def states(self) -> list[int]:
        """Numbers of the states that were written to the end."""
        found = (x for x in self._names(f"{self.root}/states") if x.isdigit())
        return sorted(int(x) for x in found if "_SUCCESS" in self._names(f"{self.root}/states/{x}"))

    def state(self, number: int | None = None) -> dict:
        """{number, buckets, note, tables: {table: {bucket: generation}}}; of no state an empty one."""
        known = self.states()
        if not known:
            return {"number": 0, "buckets": self.buckets, "note": {}, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.root}/states/{known[-1] if number is None else number}").first()["value"])

    def begin(self) -> Change:
        return Change(self, self.state())


class Change:
    """A state, and what a change has written on top of it so far. ``then`` reads the one, ``now`` both."""

    def __init__(self, tables: Tables, state: dict):
        self.tables, self.spark = tables, tables.spark
        self.number, self.buckets, self.note = state["number"] + 1, state["buckets"], dict(state["note"])
        self.old = {t: {int(b): g for b, g in x.items()} for t, x in state["tables"].items()}
        self.new = {t: dict(x) for t, x in self.old.items()}
        self.written: set[str] = set()

    def bucket(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys (one column): at most as many as there are."""
        return sorted(r[0] for r in keys.select(self.bucket(keys.columns[0])).distinct().collect())

    def _read(self, at: dict, table: str, buckets: list[int] | None) -> DataFrame:
        schema, _ = self.tables.schemas[table]
        held = at.get(table, {})
        paths = [f"{self.tables.root}/{table}/g{held[b]}/bucket={b}" for b in (sorted(held) if buckets is None else buckets) if b in held]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _of(self, at: dict, table: str, keys: DataFrame) -> DataFrame:
        key = self.tables.schemas[table][1]
        return self._read(at, table, self.touched(keys)).join(keys.toDF(key).distinct(), key, "left_semi")

    def then(self, table: str, keys: DataFrame | None = None) -> DataFrame:
        """The rows of ``keys`` (one column of values of the table's key), or all, before the change."""
        return self._read(self.old, table, None) if keys is None else self._of(self.old, table, keys)

    def now(self, table: str, keys: DataFrame | None = None) -> DataFrame:
        return self._read(self.new, table, None) if keys is None else self._of(self.new, table, keys)

    def beside(self, table: str, buckets: list[int]) -> DataFrame:
        """All rows, before the change, of some buckets."""
        return self._read(self.old, table, buckets)

    def put(self, table: str, buckets: list[int] | None, rows: DataFrame) -> None:
        """``rows`` are from now on all that these buckets hold, or the whole table."""
        schema, key = self.tables.schemas[table]
        buckets = list(range(self.buckets)) if buckets is None else buckets
        if not buckets:
            return
        if table in self.written:
            raise ValueError(f"{table} was written in this change already")
        self.written.add(table)
        path, names = f"{self.tables.root}/{table}/g{self.number}", self.spark.createDataFrame([], schema).columns
        dealt = rows.select(*names).withColumn("bucket", self.bucket(key)).repartition("bucket").sortWithinPartitions("bucket", key)
        dealt.write.partitionBy("bucket").mode("overwrite").option("compression", "zstd").parquet(path)
        written = {int(x.split("=")[1]) for x in self.tables._names(path) if x.startswith("bucket=")}
        held = self.new.setdefault(table, {})
        for b in buckets:
            if b in written:
                held[b] = self.number
            else:  # nothing is left in it
                held.pop(b, None)

    def commit(self, **note) -> None:
        """Let readers see the change; a ValueError if another one came in between."""
        t = self.tables
        known = t.states()
        if known and known[-1] >= self.number:
            raise ValueError(f"state {known[-1]} of {t.root} was written meanwhile")
        text = json.dumps({"number": self.number, "buckets": self.buckets, "note": self.note | note, "tables": self.new})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{t.root}/states/{self.number}")
        for table, held in self.old.items():  # generations of buckets that the state before had already left behind
            kept = {(b, g) for b, g in [*held.items(), *self.new.get(table, {}).items()]}
            for g in (x for x in t._names(f"{t.root}/{table}") if x[1:].isdigit()):
                for b in (x for x in t._names(f"{t.root}/{table}/{g}") if x.startswith("bucket=")):
                    if (int(b.split("=")[1]), int(g[1:])) not in kept:
                        p, fs = t._fs(f"{t.root}/{table}/{g}/{b}")
                        fs.delete(p, True)

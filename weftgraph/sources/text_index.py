"""A stored full-text index: runs of postings by the beginning of their tokens, sorted by token, and a table of documents.

A search reads the folders of its words' first two letters, and in these the row groups that can hold them; a word as a prefix is a
range of them. An update writes a run of its own documents; documents tell in which run they stand, so older postings of theirs
don't count. More than ``RUNS`` runs are merged into one. Numbers and sizes of documents are kept, not counted again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import search
from weftgraph.operators.settle import merged, written
from weftgraph.sources.bucketed import Tables

RUNS = 4
_POSTINGS = "token string, key string, tf long, size int, head string"


def head(token: Column) -> Column:
    """The folder of a token: its first two characters, filled up, so that a longer prefix lies in one folder."""
    return F.rpad(F.substring(token, 1, 2), 2, "_")


class TextIndex:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 8):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = Tables(spark, self.root, {"docs": ("key string, size int, run int", "key")}, buckets)

    def exists(self) -> bool:
        return bool(self.tables.states())

    def _note(self) -> dict:
        return {"runs": [], "last": 0, "n": 0, "total": 0} | self.tables.state()["note"]

    def _write(self, postings: DataFrame, run: int) -> None:
        rows = postings.select("token", "key", "tf", "size", head(F.col("token")).alias("head"))
        # By range, so that a token in every document is spread over tasks too.
        rows.repartitionByRange("head", "token", "key").sortWithinPartitions("head", "token", "key").write.mode("overwrite").option("compression", "zstd").partitionBy("head").parquet(f"{self.root}/postings/run={run}")

    def _run(self, run: int) -> DataFrame:
        return self.spark.read.schema(_POSTINGS).parquet(f"{self.root}/postings/run={run}").withColumn("run", F.lit(run))

    def update(self, docs: DataFrame) -> None:
        """Put ``docs`` (key, text) in place of what the index has of these keys; a null text takes a document out."""
        note, change = self._note(), self.tables.begin()
        run = note["last"] + 1
        rows = docs.select(F.col("key").cast("string").alias("key"), F.col("text"))
        found = search.inverted_index(rows.filter("text IS NOT NULL"), "key", "text").select("token", "key", "tf", F.col("size").cast("int").alias("size"))
        self._write(found, run)
        # Written, as it is read twice and texts are long to cut into words.
        sizes = written(rows.select("key", F.size(search.tokens(F.col("text"))).alias("size"), F.col("text").isNull().alias("out")))
        old = change.then("docs", rows.select("key"))
        n, total = old.filter("size > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        new = sizes.filter("NOT out").select("key", "size", F.lit(run).alias("run"))
        more, longer = new.filter("size > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        left = lambda docs: docs.join(merged(rows.select("key")), "key", "left_anti").unionByName(new)
        runs = [*note["runs"], run]
        if len(runs) <= RUNS:
            buckets = change.touched(rows.select("key"))
            change.put("docs", buckets, left(change.beside("docs", buckets)))
        else:
            docs = left(change.then("docs"))
            self._write(self._live(runs, docs), run + 1)
            change.put("docs", None, docs.withColumn("run", F.lit(run + 1)))
            runs = [run + 1]
        change.commit(runs=runs, last=runs[-1], n=note["n"] - n + more, total=int(note["total"] - total + longer))
        for old_run in set(note["runs"]) - set(runs):
            path, fs = self.tables._fs(f"{self.root}/postings/run={old_run}")
            fs.delete(path, True)

    def _live(self, runs: list[int], docs: DataFrame, where: Column | None = None) -> DataFrame:
        """Postings of the runs whose documents stand there."""
        out = None
        for run in runs:
            rows = self._run(run) if where is None else self._run(run).filter(where)
            out = rows if out is None else out.unionByName(rows)
        return out.join(docs.select("key", "run"), ["key", "run"], "left_semi") if len(runs) > 1 else out

    def hits(self, words: list[str]) -> DataFrame:
        """(token, key, tf, size) of the postings that ``words`` ask for; a single word is a prefix."""
        if len(words) == 1:
            word = words[0]
            folders = F.col("head").startswith(word) if len(word) < 2 else F.col("head") == word[:2]
            where = folders & F.col("token").startswith(word)
        else:
            where = F.col("head").isin(sorted({(w[:2] + "_")[:2] for w in words})) & F.col("token").isin(words)
        return self._live(self._note()["runs"], self.tables.begin().then("docs"), where).select("token", "key", "tf", "size")

    def search(self, query: str, limit: int = 50, digits: int = 9, key: str = "string") -> DataFrame:
        """(key, score) by BM25, as ``search.bm25_documents`` over the same documents gives them; keys are compared as of type ``key``."""
        words, note = search.query_words(query), self._note()
        if not words or not note["n"]:
            return self.spark.createDataFrame([], f"key {key}, score double")
        sizes = self.spark.createDataFrame([(note["n"], note["total"] / note["n"])], "n long, mean double")
        return search.ranked(self.hits(words).withColumn("key", F.col("key").cast(key)), sizes, words, limit, digits)

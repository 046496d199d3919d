"""Incremental substring deduplication with a log-structured fingerprint index.

The index is a list of immutable runs. A run holds the hashes of every stretch of windows (see
``repeats``) that was new when its batch came, with its anchor and place, bucketed and sorted by them. A new batch is
reduced to its own different stretches, merge-joined with the runs, and what it repeats is told apart from what
it brings. A copy counts only when a further hash of its words, taken from the text, agrees with that of the first
place; stretches that share only their anchor with others are compared window by window on the texts. New stretches
become the next run, and when there are more than ``FAN`` runs they are compacted into one. A whole table is taken as
``BATCHES`` batches, so that runs are joined, verified and compacted on the way.

Defined results: null or empty text has no words; a text shorter than a window loses nothing; rows without an id come
last; rows that repeat an id are one document, whose removed windows count for each of them; equal places
don't remove each other; texts of any length are read in parts; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import repeats as R
from weftgraph.llm.bloom import members
from weftgraph.llm.storage import materialize, release

FAN, BATCHES = 1, 3
#: Least number of buckets of a run, and bytes of text for each more.
BUCKETS, BUCKET_BYTES = 32, 1 << 28
_RUN = ["a", "s", "v", "place", "c"]


class FingerprintIndex:
    def __init__(self, spark: SparkSession, unit: R.Unit = R.WORDS20, buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.unit, self.buckets, self.fan, self.runs = spark, unit, buckets, fan, []
        self.compactions = 0

    def history(self) -> DataFrame | None:
        return reduce(DataFrame.unionByName, map(self.spark.table, self.runs)) if self.runs else None

    def _add_run(self, rows: DataFrame) -> None:
        name = f"weft_run_{uuid.uuid4().hex}"
        rows.select(*_RUN).repartition(self.buckets, "a", "s").write.bucketBy(self.buckets, "a", "s").sortBy("a", "s").option("compression", "zstd").saveAsTable(name)
        self.runs.append(name)

    def compact(self) -> None:
        """Merge all runs into one; no stretch is in two of them."""
        old, rows = self.runs, self.history()
        self.runs = []
        self._add_run(rows)
        self.drop(old)
        self.compactions += 1

    def drop(self, names: list[str] | None = None) -> None:
        for name in list(self.runs) if names is None else names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs = [] if names is None else self.runs

    def _before(self, batch: DataFrame) -> DataFrame:
        """The batch's different stretches, each with the place and the check any run has for it."""
        own = R.firsts(R.stretch_rows(batch, self.unit))
        for i, name in enumerate(self.runs):
            run = self.spark.table(name).select("a", "s", F.struct("place", "v").alias(f"run{i}"))
            own = own.join(run.hint("merge"), ["a", "s"], "left")
        old = [F.col(f"run{i}") for i in range(len(self.runs))]
        old = F.coalesce(*old) if len(old) > 1 else old[0] if old else F.lit(None).cast("struct<place:decimal(38,0),v:bigint>")
        return own.withColumn("old", old).select(*_RUN, "n", "old")

    def ingest(self, batch: DataFrame, corpus: DataFrame, remember: bool = True) -> DataFrame:
        """Removed windows (doc, start, c) of ``batch`` (doc, text), whose ids follow those of earlier batches.
        ``corpus`` holds the texts of this and all earlier batches, for verification."""
        different = materialize(self._before(batch), "batch")
        known = materialize(different.filter("n > 1 OR old IS NOT NULL").select("a", "s", *R.first_place(F.coalesce("old.place", "place")), F.coalesce("old.v", "v").alias("check"), "n"), "known")
        met = R.placed(batch, self.unit, known, known.count()).filter(R.later(self.unit) & (F.col("v") == F.col("check")))
        out = met.select("doc", "start", "c")
        new = different.filter("old IS NULL").select(*_RUN)
        n = new.count()
        asked = new.select("a", "place", "c", F.lit(True).alias("fresh"))
        if self.runs:
            plane = members(new.select(F.col("a").alias("h")).distinct(), n)
            asked = asked.unionByName(self.history().filter(plane.test("a")).select("a", "place", "c", F.lit(False).alias("fresh")))
        asked = R.contested(asked, n).select(R.doc_of().alias("doc"), R.start_of().alias("start"), "c", "fresh")
        out = materialize(out.unionByName(R.repeated_windows(corpus, self.unit, asked)), "removed")
        if remember:
            self._add_run(new)
            if len(self.runs) > self.fan:
                self.compact()
        release(different, known)
        return out


def removed_windows(docs: DataFrame, unit: R.Unit = R.WORDS20, batches: int = BATCHES) -> DataFrame:
    """Removed windows of all ``docs`` (doc, text), taken as ``batches`` batches in the order of ids."""
    size, cuts = docs.agg(F.sum(F.octet_length("text").cast("long")), F.percentile_approx("doc", [i / batches for i in range(1, max(2, batches))])).first()
    index = FingerprintIndex(docs.sparkSession, unit, max(BUCKETS, (size or 0) // BUCKET_BYTES))
    edges = [None, *sorted(set(cuts or []) if batches > 1 else []), None]
    out = []
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        after = F.lit(True) if low is None else F.col("doc") > low
        batch = docs.filter(after if high is None else after & (F.col("doc") <= high))
        corpus = docs if high is None else docs.filter(F.col("doc") <= high)
        out.append(index.ingest(batch, corpus, remember=i < len(edges) - 2))
    index.drop()
    return reduce(DataFrame.unionByName, out)


def report(docs: DataFrame, unit: R.Unit = R.WORDS20, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of ``docs`` (doc_id, text)."""
    rows = R.plain(docs)
    out = R.report(rows, unit, removed_windows(rows, unit, batches))
    return out.select(F.when(F.col("doc") < R.LAST, F.col("doc")).alias("doc_id"), F.col("n").alias("n_words"), "n_removed", "kept_sha256")

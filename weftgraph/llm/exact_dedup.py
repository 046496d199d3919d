"""Exact deduplication by two-pass Bloom filtering.

Pass one feeds the hash of every normalised text into a Bloom filter with two bit planes:
bits set once, and bits set again by another row. Pass two tests each row against the second
plane. A row that fails is the only one of its text and passes straight through; the others
(repeated texts and a few false alarms) are the only rows that shuffle.

Defined results: null text counts as empty; texts are equal when identical after each run of
space characters became one space; the smallest doc_id of a group stays, null ids sorting
last; rows that repeat the kept id are that document again and are marked alike (``deduplicate``
keeps one of them); a text of any length is hashed as one row; an empty table gives an empty table; other columns,
whatever their names, pass untouched.

Beyond 16 MB of plane (some 16 million rows) hashes are dealt by range over tasks, each with two planes of its own;
only where the hashes that repeat outgrow a plane too do rows move to be told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.bloom import MAX_BITS, split_repeats
from weftgraph.llm.storage import join_groups, materialize

def normalised(text: F.Column) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: F.Column) -> F.Column:
    return F.sha2(normalised(text), 256)


def decide(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("text_sha256")).withColumn("h", F.xxhash64("text_sha256")), "exact")
    n = hashed.count()
    alone, again = split_repeats(hashed, n, max_bits)(hashed)
    alone = alone.select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    again = again.select("doc_id", "text_sha256")
    groups = again.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    out = alone.unionByName(join_groups(again, groups, "text_sha256", "group_size", n))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; texts that occur once don't move while a plane can tell."""
    hashed = materialize(docs.select(F.col("doc_id").alias("doc_id"), digest(F.col("text")).alias("sha")).withColumn("h", F.xxhash64("sha")), "exact")
    split = split_repeats(hashed, hashed.count(), max_bits)
    # Rows travel as one struct, so that no column of theirs clashes with the hash.
    keyed = docs.select(F.struct(*docs.columns).alias("row"), digest(F.col("text")).alias("sha")).withColumn("h", F.xxhash64("sha"))
    alone, repeated = split(keyed)
    again = split(hashed)[1]
    keep = again.groupBy("sha").agg(F.min("doc_id").alias("keep_id")).select(F.col("sha").alias("keep_sha"), "keep_id")
    # On text and id together: the rows of a hot text are dealt over all tasks.
    stay = repeated.join(keep, (F.col("sha") == F.col("keep_sha")) & F.col("row.doc_id").eqNullSafe(F.col("keep_id")), "left_semi")
    twice = again.groupBy("sha", "doc_id").count().filter("count > 1")
    stay = stay if twice.isEmpty() else stay.dropDuplicates(["sha"])
    return alone.select("row.*").unionByName(stay.select("row.*")).select(*docs.columns)

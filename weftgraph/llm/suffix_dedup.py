"""Removal of byte strings that another document held before, with a run-length suffix index.

Anchored stretches (see ``repeats``) that occur once are set aside. Equal stretches collapse to one row before
anything is gathered; a later copy is removed whole. What is left, different stretches that share an
anchor, goes by anchor to shards; over a shard's stretches stands a run-compressed Burrows-Wheeler transform
with sampled run ends. Matching statistics of the stretches are streamed against it, and strings of full
width that a document with a smaller id holds are marked. A stretch that its first document holds at several places
is compared once, and what is marked is marked at each.

An anchor shared by more stretches than a shard should hold (the border of a passage that stands in countless
documents) is refined: windows are parted by where the anchor stands in them, which tells of further bytes that they
all hold, and pieces of stretches meet again by these longer keys, equal pieces collapsed. Every step halves the
places, so after five of them a piece is one window; whatever is small enough goes to the index after each.

Defined results: null text is empty; a text below the width loses nothing; rows without an id come last and repeat
nothing for each other; rows that repeat an id are one document; texts of any length are read in parts, and only their
contested stretches are gathered; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K
from weftgraph.llm import repeats as R
from weftgraph.llm.bloom import members
from weftgraph.llm.run_index import RunIndex
from weftgraph.llm.storage import join_groups, materialize, release

#: Most stretches of one anchor that meet in a shard, and stretches of a shard, about: few enough for the processor's cache.
GROUP, SHARD = 2000, 2000
#: About how many anchors one bucket of the count holds.
BUCKET = 500_000
_TEXT = "k long, q long, n long, doc long, start long, c int, p int, context binary"


def _contexts(unit: R.Unit):
    """The bytes of each requested stretch."""
    names = [x.split()[0] for x in _TEXT.split(", ")]

    def run(batches):
        for b in batches:
            (start, at), *others = (R.flat(b, x) for x in ("start", "c", "p", "k", "q", "n"))
            c, p, k, q, n = (x for x, _ in others)
            stop, context = (start + c + unit.width - 1).tolist(), []
            for i, text in enumerate(K.encoded(b.column(1))):
                context += [text[x:y] for x, y in zip(start[at[i] : at[i + 1]].tolist(), stop[at[i] : at[i + 1]], strict=True)]
            doc = np.repeat(b.column(0).to_numpy(), np.diff(at))
            cols = [*(pa.array(x, pa.int64()) for x in (k, q, n, doc, start)), pa.array(c, pa.int32()), pa.array(p, pa.int32()), pa.array(context, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


_MARK = "k long, q long, n long, doc long, start long, at array<int>, size array<int>"


def _mark(unit: R.Unit):
    """Marks of one shard's stretches: where they begin (windows) and how many windows each has."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        k, doc, texts = table["k"].to_numpy(), table["doc"].to_numpy(), table["context"].to_pylist()
        groups = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        # Strings are shared only within an anchor, so its first document's stretches hold nothing that came before.
        lowest = np.repeat(np.minimum.reduceat(doc, groups), np.diff(np.append(groups, len(k))))
        asked = np.flatnonzero(doc > lowest)
        rows, at, size = [], [], []
        if len(asked):
            index = RunIndex(texts, doc, unit.width)
            least, first = index.least_values(asked)
            hit = least < np.repeat(doc[asked], np.diff(np.append(first, len(least))))
            edge = np.zeros(len(least) + 1, bool)
            edge[first] = edge[-1] = True
            begins = np.flatnonzero(hit & (edge[:-1] | ~np.append(False, hit[:-1])))
            stops = np.flatnonzero(hit & (edge[1:] | ~np.append(hit[1:], False))) + 1
            owner = np.searchsorted(first, begins, "right") - 1
            held, cut = np.unique(owner, return_index=True)
            rows = asked[held]
            at = [x.tolist() for x in np.split(begins - first[owner], cut[1:])] if len(held) else []
            size = [x.tolist() for x in np.split(stops - begins, cut[1:])] if len(held) else []
        found = table.select(["k", "q", "n", "doc", "start"]).take(pa.array(rows, pa.int64()))
        return found.append_column("at", pa.array(at, pa.list_(pa.int32()))).append_column("size", pa.array(size, pa.list_(pa.int32())))

    return run


def _indexed(texts: DataFrame, unit: R.Unit, n: int) -> DataFrame:
    """Marks of the ``n`` stretches or pieces ``texts`` (see _TEXT), whose keys are shared by few."""
    shards = max(1, n // SHARD)
    dealt = texts.drop("c", "p").withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_mark(unit), _MARK)


_PIECE = "k long, q long, doc long, start long, c int, p int, context binary, a long, s long, n long, origin long, low int, high int"


def _split(unit: R.Unit):
    """Each row's windows in two pieces, by where its anchor stands in them, keyed by the bytes that all windows of that part hold."""
    names = [x.split()[0] for x in _PIECE.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                half = (r["low"] + r["high"]) // 2
                for low, high in ((r["low"], half), (half + 1, r["high"])):
                    # Window j of the row holds the anchor at place p - j.
                    one, two = max(0, r["p"] - high), min(r["c"] - 1, r["p"] - low)
                    if low > high or one > two:
                        continue
                    shared = r["context"][r["p"] - low : r["p"] + unit.width - high]
                    own, p = r["context"][one : two + unit.width], r["p"] - one
                    key = xxhash.xxh3_64_intdigest(shared, seed=(low << 16) + high)
                    piece = xxhash.xxh3_64_intdigest(own, seed=(p << 32) + (low << 16) + high)
                    out.append((key - (1 << 63), piece - (1 << 63), r["doc"], r["start"] + one, two - one + 1, p, own, r["a"], r["s"], r["n"], r["origin"], low, high))
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32() if n in ("c", "p", "low", "high") else pa.binary() if n == "context" else pa.int64()) for n, x in zip(names, cols, strict=True))], names)

    return run


def _refined(texts: DataFrame, unit: R.Unit, group: int) -> list[DataFrame]:
    """Marks of ``texts`` (see _TEXT) whose keys are shared by too many: tables like _MARK, k and q the stretch's own."""
    last = unit.width - unit.gram
    rows = texts.select("k", "q", "doc", "start", "c", "p", "context", F.col("k").alias("a"), F.col("q").alias("s"), "n", F.col("start").alias("origin"), F.lit(0).alias("low"), F.lit(last).alias("high"))
    out = []
    for _ in range(last.bit_length()):
        rows = materialize(rows.mapInArrow(K.tidy(_split(unit)), _PIECE), "pieces")
        different = rows.groupBy("k", "q").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("n"), *(F.first(x).alias(x) for x in ("c", "p", "context")))
        different = materialize(different.select("k", "q", "n", "doc", F.lit(0).cast("long").alias("start"), "c", "p", "context"), "different")
        groups = different.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("rows"))
        groups = materialize(groups.filter("rows > 1"), "keys")
        few = join_groups(different, groups.filter(F.col("m") <= group), "k", "m", different.count()).select(*different.columns)
        marks = _indexed(few, unit, few.count()).withColumn("marked", F.lit(True))
        # What is equal to an earlier document's piece goes whole; its first document's pieces as the index says.
        none = F.array().cast("array<int>")
        answers = marks.unionByName(few.filter("n > 1").select("k", "q", "n", "doc", "start", none.alias("at"), none.alias("size"), F.lit(False).alias("marked")))
        answers = materialize(answers.groupBy("k", "q").agg(F.max("n").alias("of"), F.max("doc").alias("first"), F.max(F.when(F.col("marked"), F.col("at"))).alias("at"), F.max(F.when(F.col("marked"), F.col("size"))).alias("size")), "answers")
        met = join_groups(rows, answers, ["k", "q"], "of", rows.count())
        # The shift is a column first: in a lambda beside an alias named start, start would mean the alias.
        met = met.withColumn("shift", (F.col("start") - F.col("origin")).cast("int"))
        whole = F.col("doc") > F.col("first")
        at = F.when(whole, F.array("shift")).otherwise(F.transform("at", lambda x: x + F.col("shift")))
        size = F.when(whole, F.array("c")).otherwise(F.col("size"))
        out.append(met.select(F.col("a").alias("k"), F.col("s").alias("q"), "n", "doc", F.col("origin").alias("start"), at.alias("at"), size.alias("size")).filter("at IS NOT NULL"))
        many = groups.filter(F.col("m") > group)
        if many.isEmpty():
            break
        rows = join_groups(rows, many.select("k", "rows"), "k", "rows", rows.count()).select(*rows.columns)
    return out


def _spread(marks: DataFrame) -> DataFrame:
    """(doc, start, c) of the marks (doc, start, at, size) of stretches."""
    return marks.select("doc", "start", F.explode(F.arrays_zip("at", "size")).alias("x")).select("doc", (F.col("start") + F.col("x.at")).alias("start"), F.col("x.size").alias("c"))


def removed_strings(docs: DataFrame, unit: R.Unit = R.BYTES50, group: int = GROUP) -> DataFrame:
    """Removed windows (doc, start, c) of ``docs`` (doc, text)."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(64, 2 * size // (unit.width - unit.gram) // BUCKET)
    shared = materialize(R.shared_anchors(docs, unit, buckets), "anchors")
    rows = R.stretch_rows(docs, unit, anchors=(members(shared, shared.count()), buckets))
    different = materialize(R.firsts(rows.drop("v")), "stretches")
    release(shared)
    known = materialize(different.filter("n > 1").select("a", "s", *R.first_place(F.col("place")), "n"), "known")
    placed = R.placed(docs, unit, known, known.count()).filter("doc <> first_doc OR start <> first_start")
    placed = materialize(placed.select("a", "s", "doc", "start", "c", R.later(unit).alias("whole")), "placed")
    release(known)
    again = placed.filter("NOT whole").select("a", "s", "doc", "start").distinct()
    rivals = R.contested(different.withColumn("fresh", F.lit(True)), different.count()).select(F.col("a").alias("k"), F.col("s").alias("q"), "n", "m", R.doc_of().alias("doc"), R.start_of().alias("start"), "c", "p")
    rivals = materialize(rivals, "rivals")
    release(different)
    texts = lambda asked: R.with_requests(docs, asked, "start c p k q n").mapInArrow(K.tidy(_contexts(unit)), _TEXT)
    few, many = rivals.filter(F.col("m") <= group), rivals.filter(F.col("m") > group)
    marks = [_indexed(texts(few), unit, few.count())]
    if not many.isEmpty():
        marks += _refined(texts(many), unit, group)
    for i, x in enumerate(marks[1:], 1):
        marks[0] = marks[0].unionByName(x)
    marks = materialize(marks[0], "marks")
    release(rivals)
    held = marks.filter("n > 1").select(F.col("k").alias("a"), F.col("q").alias("s"), "at", "size")
    elsewhere = again.join(held, ["a", "s"])
    return placed.filter("whole").select("doc", "start", "c").unionByName(_spread(marks)).unionByName(_spread(elsewhere))


def report(docs: DataFrame, unit: R.Unit = R.BYTES50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs`` (doc_id, text)."""
    rows = R.plain(docs)
    out = R.report(rows, unit, removed_strings(rows, unit))
    return out.select(F.when(F.col("doc") < R.LAST, F.col("doc")).alias("doc_id"), F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")

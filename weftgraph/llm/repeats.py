"""Repeated stretches of words or bytes, found through content-chosen anchors.

Every window of ``width`` symbols picks one anchor: its gram of lowest hash. Equal windows pick equal anchors,
so consecutive windows with one anchor make a stretch, and equal stretches hold equal windows. Stretches,
a fraction of the windows in number, are what is counted, sorted and joined; windows themselves are compared only
where different stretches share an anchor (at the edges of copies). However texts are cut into stretches, the result is
exact up to equality of two 64-bit hashes, the anchor's and the stretch's: stretches are only ever compared within an
anchor. Windows are hashed by powers of a base modulo 2**64; over so few symbols as a window has, no two
texts whatever their form agree by more than chance in over 40 bits (long ones could: words are hashed otherwise).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K
from weftgraph.llm.bloom import Plane, members
from weftgraph.llm.storage import join_groups, materialize

_U = np.uint64
_A, _B, _C = _U(0x8CB92BA72F3D8DD7), _U(0xAAAAAAAAAAAAAAAB), _U(0xC2B2AE3D27D4EB4F)
#: The id of rows without one: they come last.
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Unit:
    """Windows of ``width`` words or bytes, anchored at grams of ``gram`` of them; ``within``: whether an earlier
    start in the same document counts too."""

    words: bool
    width: int
    gram: int
    within: bool

    def symbols(self, block: K.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A hash of each symbol, and the first and the end symbol of each document."""
        if self.words:
            w = K.words(block, K.SOLID, K.CODES)
            return w.hash, w.bounds[:-1], w.bounds[1:]
        return K.CODES.take(block.data), block.begin, block.end


WORDS20 = Unit(True, 20, 5, True)
BYTES50 = Unit(False, 50, 20, False)


def _prefix(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of ``h`` under powers of a base, and the inverse powers that move a difference to the origin."""
    up, down = K.powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, _U)
    np.multiply(h, up[: len(h)], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    return sums, down


def window_hashes(unit: Unit, h: np.ndarray) -> np.ndarray:
    """Hashes of all windows of ``h``; those over the border of two documents are of no use."""
    if len(h) < unit.width:
        return np.empty(0, _U)
    sums, down = _prefix(h)
    n = len(h) - unit.width + 1
    return K.mix((sums[unit.width :] - sums[:n]) * down[:n])


#: Windows whose least grams are looked for at a time: what that takes stays in the processor's cache.
_CHUNK = 1 << 13
#: 44 bits of hash above 20 of position: the least entry is the lowest hash, and the first of equal ones.
_PLACE = _U((1 << 20) - 1)


def _least_grams(unit: Unit, sums: np.ndarray, down: np.ndarray) -> np.ndarray:
    """For each window, the entry of its gram of lowest hash."""
    reach, n = unit.width - unit.gram + 1, len(sums) - unit.width
    out = np.empty(n, _U)
    one, two = np.empty(_CHUNK + reach, _U), np.empty(_CHUNK + reach, _U)
    for at in range(0, n, _CHUNK):
        windows = min(_CHUNK, n - at)
        m = windows + reach - 1
        low, other = one[:m], two[:m]
        np.subtract(sums[at + unit.gram : at + unit.gram + m], sums[at : at + m], out=low)
        low *= down[at : at + m]
        np.right_shift(low, _U(29), out=other)
        low ^= other
        low *= _A
        low &= ~_PLACE
        low |= np.arange(at, at + m, dtype=_U)
        have = 1
        while have < reach:
            step = min(have, reach - have)
            low, other = np.minimum(low[:-step], low[step:], out=other[: len(low) - step]), low
            have += step
        out[at : at + windows] = low
    return out


def stretches(unit: Unit, block: K.Block) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, stretch, document, first window, windows, symbols from there to the anchor, check) arrays; a part of a long
    document at a time. The check of words is a hash apart from the stretch's, of bytes it is 0."""
    h, first, end = unit.symbols(block)
    following = np.append(first[1:], len(h))
    for at in range(0, max(0, len(h) - unit.width + 1), K.BLOCK):
        sums, down = _prefix(h[at : at + K.BLOCK + unit.width - 1])
        low = _least_grams(unit, sums, down)
        n = len(low)
        inside = np.ones(n, bool)
        i, j = np.searchsorted(following, at, "right"), np.searchsorted(first, at + n)
        for x, y in zip(np.maximum(first[i:j], end[i:j] - unit.width + 1).tolist(), following[i:j].tolist(), strict=True):
            inside[max(0, x - at) : max(0, y - at)] = False
        fresh = np.ones(n, bool)
        np.not_equal(low[1:], low[:-1], out=fresh[1:])
        fresh[1:] |= ~inside[:-1]
        begin = np.flatnonzero(fresh & inside)
        if len(begin):
            stop = np.flatnonzero(np.append((fresh | ~inside)[1:], True) & inside)
            pick = (low[begin] & _PLACE).astype(np.int64)
            one, two = ((sums[x + unit.width] - sums[x]) * down[x] for x in (begin, stop))
            count = stop - begin + 1
            s = K.mix(K.mix(one) * _A + K.mix(two) * _B + count.astype(_U) * _C + (pick - begin).astype(_U))
            check = np.zeros(len(begin), _U)
            if unit.words:
                more, down = _prefix(K.mix(h[at : at + K.BLOCK + unit.width - 1] ^ _C))
                check = K.mix((more[stop + unit.width] - more[begin]) * down[begin])
            doc = (np.searchsorted(first, begin + at, "right") - 1).astype(np.int32)
            yield K.mix((sums[pick + unit.gram] - sums[pick]) * down[pick]), s, doc, begin + at - first[doc], count, pick - begin, check


#: Places are one number, document times this and the start in it: a hash aggregate can hold the least of them.
SPAN = 1 << 40
_ROW = "a long, s long, place decimal(38,0), c int, p int, v long"
_AT = "a long, s long, doc long, start long, c int, v long"


def _places(doc: np.ndarray, start: np.ndarray) -> pa.Array:
    both = np.empty((len(doc), 2), np.int64)
    both[:, 0] = (doc << 40) | start
    both[:, 1] = doc >> 24
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(doc), [None, pa.py_buffer(both)])


def start_of(place: F.Column | None = None) -> F.Column:
    return F.pmod(F.col("place") if place is None else place, F.lit(SPAN).cast("decimal(38,0)")).cast("long")


def doc_of(place: F.Column | None = None) -> F.Column:
    place, span = F.col("place") if place is None else place, F.lit(SPAN).cast("decimal(38,0)")
    return F.call_function("div", place - F.pmod(place, span), span)


def stretch_rows(docs: DataFrame, unit: Unit, anchors: tuple[Plane, int] | None = None, known: Plane | None = None) -> DataFrame:
    """All stretches of ``docs`` (doc, text), or those whose anchor (by filter and number of buckets) or own hash a filter
    lets through; of ``known`` ones document and start instead of the place."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for block in K.blocks(K.encoded(b.column(1))):
                for found in stretches(unit, block):
                    if anchors or known:
                        keep = np.flatnonzero(anchors[0].match(anchor_key(found[0], anchors[1])) if anchors else known.match(found[1]))
                        found = [x[keep] for x in found]
                    a, s, doc, start, n, p, v = found
                    a, s, v, n, doc = pa.array(a.view(np.int64)), pa.array(s.view(np.int64)), pa.array(v.view(np.int64)), pa.array(n.astype(np.int32)), ids[block.first + doc]
                    if known:
                        yield pa.RecordBatch.from_arrays([a, s, pa.array(doc), pa.array(start), n, v], ["a", "s", "doc", "start", "c", "v"])
                    else:
                        yield pa.RecordBatch.from_arrays([a, s, _places(doc, start), n, pa.array(p.astype(np.int32)), v], ["a", "s", "place", "c", "p", "v"])

    return docs.mapInArrow(K.tidy(run), _AT if known else _ROW)


def _folded(a: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An anchor's bucket, and 32 other bits of it. Buckets follow the corpus, so the chance that two share both stays small."""
    return ((a >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64), (a & _U(0xFFFFFFFF)).astype("<u4")


def anchor_key(a: np.ndarray, buckets: int) -> np.ndarray:
    bucket, low = _folded(a, buckets)
    return bucket << 32 | low.astype(np.int64)


def shared_anchors(docs: DataFrame, unit: Unit, buckets: int) -> DataFrame:
    """Keys (column h) of anchors that occur more than once. Tasks send the distinct ones of a batch in packed
    blocks, four bytes each, so a common one weighs no more than a rare one."""

    def pack(batches):
        for b in batches:
            got = [a for block in K.blocks(K.encoded(b.column(1))) for a, *_ in stretches(unit, block)]
            if not got:
                continue
            h, n = np.unique(anchor_key(np.concatenate(got), buckets), return_counts=True)
            bucket, low = h >> 32, (h & 0xFFFFFFFF).astype("<u4")
            held, cut = np.unique(bucket, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array([x.tobytes() for x in np.split(low, cut[1:])], pa.binary()), pa.array([np.packbits(x).tobytes() for x in np.split(n > 1, cut[1:])], pa.binary())], ["bucket", "once", "more"])

    def merge(table: pa.Table) -> pa.Table:
        seen = [np.frombuffer(x, "<u4") for x in table["once"].to_pylist()]
        more = [np.unpackbits(np.frombuffer(y, np.uint8), count=len(x)).astype(bool) for x, y in zip(seen, table["more"].to_pylist(), strict=True)]
        h, n = np.unique(np.concatenate(seen), return_counts=True)
        again = np.union1d(h[n > 1], np.concatenate([x[y] for x, y in zip(seen, more, strict=True)]))
        return pa.table({"h": pa.array(again.astype(np.int64) | table["bucket"][0].as_py() << 32)})

    return docs.mapInArrow(K.tidy(pack), "bucket int, once binary, more binary").groupBy("bucket").applyInArrow(merge, "h long")


def firsts(rows: DataFrame) -> DataFrame:
    """Each different stretch once: where it comes first, and in how many rows it occurs."""
    same = [x for x in ("c", "p", "v") if x in rows.columns]
    return rows.groupBy("a", "s").agg(F.min("place").alias("place"), *(F.first(x).alias(x) for x in same), F.count(F.lit(1)).alias("n"))


def later(unit: Unit) -> F.Column:
    """Whether a row (doc, start) comes after the first place (first_doc, first_start): anywhere, or in a later document."""
    after = F.col("doc") > F.col("first_doc")
    return after | ((F.col("doc") == F.col("first_doc")) & (F.col("start") > F.col("first_start"))) if unit.within else after


def first_place(place: F.Column) -> list[F.Column]:
    return [doc_of(place).alias("first_doc"), start_of(place).alias("first_start")]


def placed(docs: DataFrame, unit: Unit, known: DataFrame, n: int) -> DataFrame:
    """All rows of the ``known`` stretches (a, s, first_doc, first_start, n; ``n`` of them), with their first places."""
    plane = members(known.select(F.col("s").alias("h")), n)
    rows = stretch_rows(docs, unit, known=plane)
    rows = rows if unit.words else rows.drop("v")  # no check of bytes
    size = known.agg(F.sum("n")).first()[0] or 0
    return join_groups(rows, known, ["a", "s"], "n", size)


def contested(different: DataFrame, total: int) -> DataFrame:
    """Of ``different`` stretches (a, fresh, ...; ``total`` of them), those that share their anchor with another one, at
    least one of them fresh; adds m, how many do."""
    shared = different.groupBy("a").agg(F.count(F.lit(1)).alias("m"), F.max("fresh").alias("some")).filter("m > 1 AND some").drop("some")
    return join_groups(different, shared, "a", "m", total)


def with_requests(docs: DataFrame, requests: DataFrame, columns: str) -> DataFrame:
    """``docs`` (doc, text) joined to the list of ``requests`` (doc, ...) of each, as arrays; a filter keeps other texts from moving."""
    lists = materialize(requests.groupBy("doc").agg(F.collect_list(F.struct(*columns.split())).alias("asked")), "requests")
    plane = members(lists.select(F.xxhash64("doc").alias("h")), lists.count())
    found = docs.filter(plane.test(F.xxhash64("doc"))).join(lists, "doc")
    return found.select("doc", "text", *(F.col(f"asked.{c}").alias(c) for c in columns.split()))


def flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a list column, and where each row's begin."""
    column = batch.column(batch.schema.names.index(name))
    return column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets) - column.offsets[0].as_py()


def _windows(unit: Unit):
    """The windows of requested stretches, a batch for each block: one for each document would cost more than what is in it."""

    def run(batches):
        for b in batches:
            ids, start, c, fresh = b.column(0).to_numpy(), *(flat(b, x) for x in ("start", "c", "fresh"))
            for block in K.blocks(K.encoded(b.column(1))):
                h, first, end = unit.symbols(block)
                w = window_hashes(unit, h)
                edge = start[1][block.first : block.first + len(block) + 1]
                n = c[0][edge[0] : edge[-1]].astype(np.int64)
                at = np.repeat(start[0][edge[0] : edge[-1]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                doc = np.repeat(np.repeat(np.arange(len(block)), np.diff(edge)), n)
                ok = at <= (end - first)[doc] - unit.width
                at, doc, f = at[ok].astype(np.int64), doc[ok], np.repeat(fresh[0][edge[0] : edge[-1]].astype(bool), n)[ok]
                whose = ids[block.first + doc]
                yield pa.RecordBatch.from_arrays([pa.array(w[first[doc] + at].view(np.int64)), _places(whose, at), pa.array(whose), pa.array(at), pa.array(f)], ["w", "place", "doc", "start", "fresh"])

    return run


def windows_of(docs: DataFrame, unit: Unit, requests: DataFrame) -> DataFrame:
    """(w, place, doc, start, fresh) for every window of the requested stretches (doc, start, c, fresh)."""
    return with_requests(docs, requests, "start c fresh").mapInArrow(K.tidy(_windows(unit)), "w long, place decimal(38,0), doc long, start long, fresh boolean")


def repeated_windows(docs: DataFrame, unit: Unit, requests: DataFrame) -> DataFrame:
    """(doc, start, c = 1) of the fresh windows among the requested that another of them holds earlier."""
    rows = materialize(windows_of(docs, unit, requests), "windows")
    groups = rows.groupBy("w").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("w", "n", *first_place(F.col("place")))
    found = join_groups(rows.filter("fresh").drop("place"), groups, "w", "n", rows.count()).filter(later(unit))
    return found.select("doc", "start", F.lit(1).alias("c"))


def _kept(unit: Unit, block: K.Block, gone: np.ndarray, w: K.Words | None) -> tuple[np.ndarray, np.ndarray]:
    """The block's bytes, and which of them are what stays, words with one space between them; ``gone``: its symbols that go."""
    if not unit.words:
        keep = np.zeros(len(block.data), bool)
        for b, e, at in zip(block.begin.tolist(), block.end.tolist(), (block.begin - np.arange(len(block))).tolist(), strict=True):
            np.logical_not(gone[at : at + e - b], out=keep[b:e])
        return block.data, keep
    data, keep = block.data.copy(), K.SOLID[block.data]
    if gone.any():
        keep[keep] = np.repeat(~gone, w.end - w.begin)
    stay = np.flatnonzero(~gone)
    last = np.append(w.doc[stay][1:] != w.doc[stay][:-1], True)[: len(stay)]
    data[w.end[stay]] = 0x20
    keep[w.end[stay[~last]]] = True
    return data, keep


def report(docs: DataFrame, unit: Unit, removed: DataFrame) -> DataFrame:
    """doc, n, n_removed, n_spans, kept_sha256 for each row of ``docs`` (doc, text), given removed windows (doc, start, c)."""

    def run(batches):
        for b in batches:
            asked = "start" in b.schema.names
            (start, at), (c, _) = (flat(b, "start"), flat(b, "c")) if asked else ((np.empty(0, np.int64), np.zeros(b.num_rows + 1, int)),) * 2
            out = []
            for block in K.blocks(K.encoded(b.column(1))):
                w = K.words(block, K.SOLID) if unit.words else None
                counts = w.counts if unit.words else block.end - block.begin
                masks = []
                for i, n in enumerate(counts.tolist()):
                    lo, hi = at[block.first + i], at[block.first + i + 1]
                    from_ = np.minimum(start[lo:hi], n)
                    to = np.minimum(start[lo:hi] + c[lo:hi] + unit.width - 1, n)
                    masks.append(K.spans_cover(from_, to - from_, n) if hi > lo else np.zeros(n, bool))
                data, keep = _kept(unit, block, np.concatenate(masks), w)
                for mask, x, y in zip(masks, block.begin.tolist(), block.end.tolist(), strict=True):
                    out.append((len(mask), int(mask.sum()), len(K.runs_of(mask)[0]), hashlib.sha256(data[x:y][keep[x:y]].tobytes()).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.string())], ["doc", "n", "n_removed", "n_spans", "kept_sha256"])

    shape = "doc long, n long, n_removed long, n_spans long, kept_sha256 string"
    lists = materialize(removed.groupBy("doc").agg(F.collect_list(F.struct("start", "c")).alias("asked")), "removed")
    plane = members(lists.select(F.xxhash64("doc").alias("h")), lists.count())
    some = docs.filter(plane.test(F.xxhash64("doc"))).join(lists, "doc", "left").select("doc", "text", F.coalesce("asked.start", F.array().cast("array<long>")).alias("start"), F.coalesce("asked.c", F.array().cast("array<int>")).alias("c"))
    return docs.filter(~plane.test(F.xxhash64("doc"))).select("doc", "text").mapInArrow(K.tidy(run), shape).unionByName(some.mapInArrow(K.tidy(run), shape))


def plain(docs: DataFrame) -> DataFrame:
    """doc, text without nulls: rows without an id come last, null texts are empty."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

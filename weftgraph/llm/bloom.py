"""Bloom filters built by the tasks and merged shard by shard; their size is bounded before they are sent."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K
from weftgraph.llm.storage import materialize

#: Hash functions, bits for each row, most bits of one filter (16 MB of plane), and bits of one of the shards that merge it.
PROBES, BITS_PER_ROW, MAX_BITS, SHARD_BITS = 4, 8, 1 << 27, 1 << 21
_U = np.uint64


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions for each hash, by double hashing."""
    h = h.astype(_U)
    step = (h * _U(0x9E3779B97F4A7C15) >> _U(17)) | _U(1)
    return ((h[:, None] + step[:, None] * np.arange(PROBES, dtype=_U)) >> _U(5)) & _U(bits - 1)


def _sketch(bits: int):
    """One task's share of the filter: the bits its hashes set, and those of hashes it saw twice, by shard."""
    width = min(bits, SHARD_BITS)
    shards = bits // width

    def run(batches):
        seen = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        if not seen:
            return
        h, n = np.unique(np.concatenate(seen), return_counts=True)
        once, twice = (np.unique(_positions(x, bits)) for x in (h, h[n > 1]))
        cuts = [np.searchsorted(x, np.arange(shards + 1, dtype=_U) * _U(width)) for x in (once, twice)]
        local = lambda x, c, s: (x[c[s] : c[s + 1]] - _U(s * width)).astype("<u4").tobytes()
        used = [s for s in range(shards) if cuts[0][s] < cuts[0][s + 1]]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([local(once, cuts[0], s) for s in used], pa.binary()), pa.array([local(twice, cuts[1], s) for s in used], pa.binary())], ["shard", "once", "twice"])

    return run


def _merge(bits: int, repeats: bool):
    width = min(bits, SHARD_BITS)

    def run(table: pa.Table) -> pa.Table:
        first, again = np.zeros(width, bool), np.zeros(width, bool)
        for once, twice in zip(table["once"].to_pylist(), table["twice"].to_pylist(), strict=True):
            now = np.frombuffer(once, "<u4")
            again[now[first[now]]] = True
            first[now] = True
            again[np.frombuffer(twice, "<u4")] = True
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "plane": pa.array([np.packbits(again if repeats else first).tobytes()], pa.binary())})

    return run


class Plane:
    """A finished filter: ``match`` asks with numpy hashes inside a task, ``test`` with a column."""

    def __init__(self, sent, bits: int):
        self.sent, self.bits = sent, bits

    def match(self, h: np.ndarray) -> np.ndarray:
        p = _positions(h, self.bits)
        byte = self.sent.value[(p >> _U(3)).astype(np.int64)]
        return (byte >> (_U(7) - (p & _U(7))).astype(np.uint8) & 1).all(axis=1)

    def test(self, column):
        @F.pandas_udf("boolean")
        def maybe(h: pd.Series) -> pd.Series:
            return pd.Series(self.match(h.to_numpy()))

        return maybe(column)


def _plane(hashed: DataFrame, bits: int, repeats: bool) -> Plane:
    shards = hashed.select("h").mapInArrow(K.tidy(_sketch(bits)), "shard int, once binary, twice binary").groupBy("shard").applyInArrow(_merge(bits, repeats), "shard int, plane binary")
    plane, width = np.zeros(bits // 8, np.uint8), min(bits, SHARD_BITS) // 8
    for row in shards.collect():  # bits / 8 bytes in all
        plane[row.shard * width : (row.shard + 1) * width] = np.frombuffer(row.plane, np.uint8)
    return Plane(hashed.sparkSession.sparkContext.broadcast(plane), bits)


def members(hashed: DataFrame, n: int, max_bits: int = MAX_BITS) -> Plane:
    """A test on hashes: false where no row of ``hashed`` (column h, n rows) has it. Past ``max_bits``
    the filter lets more through, so what is asked must still be joined."""
    return _plane(hashed, 1 << max(13, (min(n * BITS_PER_ROW, max_bits) - 1).bit_length()), False)


def _deal(ranges: int):
    """One task's different hashes by range, packed, with a mark on those it saw twice."""

    def run(batches):
        for b in batches:
            h, n = np.unique(b.column(0).to_numpy(zero_copy_only=False).astype(_U), return_counts=True)
            held, cut = np.unique((h >> _U(32)) * _U(ranges) >> _U(32), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array([x.tobytes() for x in np.split(h, cut[1:])], pa.binary()), pa.array([np.packbits(x).tobytes() for x in np.split(n > 1, cut[1:])], pa.binary())], ["range", "once", "twice"])

    return run


def _range_repeats(bits: int):
    """The hashes of one range that may occur twice, by two planes of its own."""

    def run(table: pa.Table) -> pa.Table:
        first, again = np.zeros(bits, bool), np.zeros(bits, bool)
        parts = [(np.frombuffer(x, _U), np.unpackbits(np.frombuffer(y, np.uint8), count=len(x) // 8).astype(bool)) for x, y in zip(table["once"].to_pylist(), table["twice"].to_pylist(), strict=True)]
        for h, twice in parts:
            p = _positions(h, bits)
            again[p[first[p].all(axis=1) | twice]] = True
            first[p] = True
        maybe = np.unique(np.concatenate([h[again[_positions(h, bits)].all(axis=1)] for h, _ in parts]))
        return pa.table({"h": pa.array(maybe.view(np.int64))})

    return run


def split_repeats(hashed: DataFrame, n: int, max_bits: int = MAX_BITS):
    """A function that parts a table with a column h into (rows whose h occurs once among the ``n`` rows of ``hashed``
    for sure, rows that may repeat).

    The filter has two planes, bits set once and bits set again. Up to ``max_bits`` its second plane is sent to the
    tasks. Beyond, hashes are dealt by range over tasks, eight bytes each and different ones alone, each range with
    planes of its own; the hashes found are sent as a filter if it fits, else they meet the rows in a join.
    """
    if n * BITS_PER_ROW <= max_bits:
        bits = 1 << max(13, (n * BITS_PER_ROW - 1).bit_length())
        plane = _plane(hashed, bits, True)
        return lambda rows: (rows.filter(~plane.test("h")), rows.filter(plane.test("h")))
    ranges, bits = -(-n * BITS_PER_ROW * 2 // max_bits), max_bits
    found = materialize(hashed.select("h").mapInArrow(K.tidy(_deal(ranges)), "range int, once binary, twice binary").groupBy("range").applyInArrow(_range_repeats(bits), "h long"), "repeated")
    m = found.count()
    if m * BITS_PER_ROW <= max_bits:
        plane = members(found, m, max_bits)
        return lambda rows: (rows.filter(~plane.test("h")), rows.filter(plane.test("h")))
    return lambda rows: (rows.join(found, "h", "left_anti"), rows.join(found, "h", "left_semi"))

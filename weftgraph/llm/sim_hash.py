"""Near-duplicates by 64-bit SimHash fingerprints that differ in few bits, found by the general pigeonhole principle.

Bits that go together over all fingerprints are put into one part of the key; parts take the 64 bits between them. Two
fingerprints at distance ``BITS`` or less agree in some part i up to its threshold, if the thresholds, -1 for a part that
isn't asked, sum up to BITS - parts + 1. Each fingerprint gets thresholds of its own: counts of part values over all
fingerprints (in a table of fixed size) tell how many candidates a part would give within 0, 1 or 2 bits, and dynamic
programming takes the cheapest split. It then probes the parts' values within its thresholds, and what it meets is
verified by the bits that differ.

Fingerprints in crowds, whose cheapest split still promises over ``HOT`` probes and candidates, don't probe. Each of them
names the 65 fingerprints within one bit of it, and those that name the same one are linked: two fingerprints at distance 2 or
less have such a neighbour in common, two that name one differ in 2 bits at most, and at most 65 name one. So no bucket, however
full, is compared all with all, and no link is lost: of a crowded and another fingerprint, the other one probes.

Defined results: a text without words, or null, has fingerprint zero, linked like any other; with fewer words than ``k`` the
whole sequence is one shingle; rows that repeat an id are one document if their texts agree, else each is judged by its text;
rows without an id share the component of their fingerprint if another row has it, else they have none; a very long text's
words and at most ``PART`` shingle hashes are held at a time; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K
from weftgraph.llm.graph import components
from weftgraph.llm.storage import join_groups, materialize, release

#: Bits in which linked fingerprints differ at most, seed of the shingles' hash, and shingles hashed at a time.
BITS, SEED, PART = 2, 42, 1 << 16
#: Cells of each part's table of counts (four bytes each), cells of a shard that merges them, and the dearest split that is probed.
CELLS, SHARD, HOT = 1 << 20, 1 << 16, 512
_U = np.uint64


def fingerprint(text: bytes, k: int) -> int:
    """The bits set in over half of the shingles' hashes."""
    words = text.lower().split()  # of bytes: A-Z alone, and the six blanks of ASCII
    if not words:
        return 0
    k = min(k, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    begin, whole, n = (end - length).tolist(), b" ".join(words), len(words) - k + 1
    end = end[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PART):
        h = np.array([xxhash.xxh64_intdigest(whole[a:b], SEED) for a, b in zip(begin[at : min(at + PART, n)], end[at : at + PART], strict=True)], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _prints(k: int):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x, k) for x in K.encoded(b.column(1))], pa.int64())], ["doc_id", "fp"])

    return run


def _together(batches):
    """How many of a task's fingerprints have bits i and j both set."""
    out = np.zeros((64, 64), np.int64)
    for b in batches:
        x = b.column(0).to_numpy().astype(">u8").view(np.uint8).reshape(-1, 8)
        for at in range(0, len(x), PART):
            one = np.unpackbits(x[at : at + PART], axis=1)[:, ::-1].astype(np.float32)
            out += (one.T @ one).astype(np.int64)
    i, j = np.nonzero(out)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(out[i, j])], ["i", "j", "n"])


def correlated_parts(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups, each grown from the bit with most correlation left by the bits most like it."""
    mean = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    like = np.abs((together / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(like, 0)
    left, out = list(range(64)), []
    for p in range(parts):
        group = [max(left, key=lambda b: (like[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < -(-(64 - sum(map(len, out))) // (parts - p)):
            group.append(max(left, key=lambda b: (like[b, group].mean(), -b)))
            left.remove(group[-1])
        out.append(sorted(group))
    return out


def how_many_parts(n: int) -> int:
    """2 or 3, whichever promises fewer probes and candidates for ``n`` fingerprints of even bits."""
    return 3 if 3 + 3 * n / 2**21 <= 34 + 34 * n / 2**32 else 2


def _keys(fp: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    """Each part's bits of the fingerprints, side by side."""
    out = []
    for bits in groups:
        key = np.zeros(len(fp), _U)
        for at, bit in enumerate(bits):
            key |= (fp >> _U(bit) & _U(1)) << _U(at)
        out.append(key)
    return out


def _cells(key: np.ndarray) -> np.ndarray:
    return (key * _U(0x9E3779B97F4A7C15) >> _U(44)).astype(np.int64)


def _counted(groups: list[list[int]]):
    """One task's counts of part values, by part and shard."""

    def run(batches):
        seen = np.zeros((len(groups), CELLS), np.uint32)
        for b in batches:
            for p, key in enumerate(_keys(b.column(0).to_numpy().astype(_U), groups)):
                seen[p] += np.bincount(_cells(key), minlength=CELLS).astype(np.uint32)
        for p in range(len(groups)):
            parts = [(s, np.flatnonzero(seen[p, s * SHARD : (s + 1) * SHARD])) for s in range(CELLS // SHARD)]
            parts = [(s, at) for s, at in parts if len(at)]
            yield pa.RecordBatch.from_arrays([pa.array([p] * len(parts), pa.int32()), pa.array([s for s, _ in parts], pa.int32()), pa.array([at.astype("<u4").tobytes() for _, at in parts], pa.binary()), pa.array([seen[p, s * SHARD + at].astype("<u4").tobytes() for s, at in parts], pa.binary())], ["part", "shard", "cell", "n"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    out = np.zeros(SHARD, np.int64)
    for cell, n in zip(table["cell"].to_pylist(), table["n"].to_pylist(), strict=True):
        out[np.frombuffer(cell, "<u4")] += np.frombuffer(n, "<u4")
    return pa.table({"part": table["part"].slice(0, 1), "shard": table["shard"].slice(0, 1), "plane": pa.array([np.minimum(out, 2**32 - 1).astype("<u4").tobytes()], pa.binary())})


def masks(width: int, most: int) -> np.ndarray:
    """What turns a value of ``width`` bits into those within ``most`` bits of it."""
    one = _U(1) << np.arange(width, dtype=_U)
    i, j = np.triu_indices(width, 1)
    return np.concatenate([np.zeros(1, _U), one, one[i] | one[j]][: most + 1])


def allocate(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds plus one of each row's parts that sum up to BITS + 1 at the least cost, and that cost.

    ``cost[p, u]``: what part p costs each row at threshold u - 1.
    """
    parts, units = cost.shape[0], BITS + 1
    best = np.full((parts + 1, units + 1, cost.shape[2]), np.inf)
    best[0, 0] = 0
    took = np.zeros((parts, units + 1, cost.shape[2]), np.int64)
    for p in range(parts):
        for s in range(units + 1):
            options = np.stack([best[p, s - u] + cost[p, u] for u in range(s + 1)])
            took[p, s] = options.argmin(axis=0)
            best[p + 1, s] = options.min(axis=0)
    left, rows = np.full(cost.shape[2], units), np.arange(cost.shape[2])
    out = np.zeros((parts, cost.shape[2]), np.int64)
    for p in reversed(range(parts)):
        out[p] = took[p, left, rows]
        left = left - out[p]
    return out, best[parts, units]


class Plan:
    """The parts, and the counts of their values over all fingerprints."""

    def __init__(self, groups: list[list[int]], counts: np.ndarray, n: int):
        self.groups, self.counts, self.n = groups, counts, n

    def near(self, p: int, key: np.ndarray, most: int) -> np.ndarray:
        """About how many fingerprints lie within ``most`` bits of each value of part ``p``."""
        width, out = len(self.groups[p]), np.zeros(len(key))
        for mask in masks(width, most):  # others share a cell: their mean is taken off
            out += np.maximum(self.counts[p, _cells(key ^ mask)] - self.n / CELLS, 0) + self.n / 2**width
        return out

    def split(self, fp: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Part values, thresholds plus one, and whether a fingerprint is in a crowd."""
        keys = _keys(fp, self.groups)
        cost = np.full((len(keys), BITS + 2, len(fp)), np.inf)
        for p, key in enumerate(keys):
            cost[p, 0] = 0
            for u in (1, 2):
                cost[p, u] = len(masks(len(self.groups[p]), u - 1)) + self.near(p, key, u - 1)
        units, best = allocate(cost)
        dear = np.flatnonzero(best > min(len(masks(len(g), BITS)) for g in self.groups))
        if len(dear):
            for p, key in enumerate(keys):
                cost[p, 3, dear] = len(masks(len(self.groups[p]), 2)) + self.near(p, key[dear], 2)
            units[:, dear], best[dear] = allocate(cost[:, :, dear])
        return keys, units, best > HOT

    def held(self, p: int, key: np.ndarray) -> np.ndarray:
        """Whether a value may be probed at all: one in more fingerprints than ``HOT`` never is."""
        return self.near(p, key, 0) <= HOT


def plan(sets: DataFrame, n: int) -> Plan:
    met = sets.select("fp").mapInArrow(K.tidy(_together), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 64 x 64 rows at most
    together = np.zeros((64, 64))
    for row in met:
        together[row["i"], row["j"]] = row["n"]
    groups = correlated_parts(together, n, how_many_parts(n))
    counts = np.zeros((len(groups), CELLS), np.uint32)
    shards = sets.select("fp").mapInArrow(K.tidy(_counted(groups)), "part int, shard int, cell binary, n binary").groupBy("part", "shard").applyInArrow(_summed, "part int, shard int, plane binary")
    for row in shards.collect():  # CELLS counts for each part
        counts[row["part"], row["shard"] * SHARD : (row["shard"] + 1) * SHARD] = np.frombuffer(row["plane"], "<u4")
    return Plan(groups, counts, n)


_KEYED = "part int, key long, id long, fp long, role int"


def _rows(part: int, key: np.ndarray, ids: np.ndarray, fp: np.ndarray, role: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(key.view(np.int64)), pa.array(ids), pa.array(fp.view(np.int64)), pa.array(np.full(len(ids), role, np.int32))], [x.split()[0] for x in _KEYED.split(", ")])


#: What a row is: held under a part's value, asking for it, or one of a crowd.
HELD, ASKS, CROWDED = 0, 1, 2


def _asked(sent):
    """Rows under each part's value, rows that ask for the values within the thresholds, and those of crowds."""

    def run(batches):
        p: Plan = sent.value
        wide = [[masks(len(g), t) for t in range(BITS + 1)] for g in p.groups]
        for b in batches:
            for at in range(0, b.num_rows, PART >> 4):
                ids, fp = (b.column(i).slice(at, PART >> 4).to_numpy() for i in (0, 1))
                fp = fp.astype(_U)
                keys, units, crowd = p.split(fp)
                yield _rows(-1, fp[crowd], ids[crowd], fp[crowd], CROWDED)
                for part, key in enumerate(keys):
                    held = p.held(part, key)
                    yield _rows(part, key[held], ids[held], fp[held], HELD)
                    for u in range(1, BITS + 2):
                        rows = np.flatnonzero((units[part] == u) & ~crowd)
                        mask = wide[part][u - 1]
                        if len(rows):
                            many = np.repeat(rows, len(mask))
                            yield _rows(part, (key[rows][:, None] ^ mask).ravel(), ids[many], fp[many], ASKS)

    return run


def linked(sets: DataFrame) -> DataFrame:
    """(a, b): links between the ids of ``sets`` (id, fp), one row for each fingerprint, that hold its components together."""
    n = sets.count()
    sent = sets.sparkSession.sparkContext.broadcast(plan(sets, n))
    keyed = materialize(sets.select("id", "fp").mapInArrow(K.tidy(_asked(sent)), _KEYED), "keyed")
    held = keyed.filter(F.col("role") == HELD).select("part", "key", F.col("id").alias("b"), F.col("fp").alias("other"))
    asks = keyed.filter(F.col("role") == ASKS).select("part", "key", F.col("id").alias("a"), "fp")
    met = asks.join(held, ["part", "key"]).filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= BITS)).select("a", "b")
    named = keyed.filter(F.col("role") == CROWDED).select("id", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("near"))
    # At most 65 fingerprints lie within one bit of another.
    stars = named.groupBy("near").agg(F.collect_list("id").alias("ids")).filter(F.size("ids") > 1).select(F.explode("ids").alias("a"), F.array_min("ids").alias("b")).filter("a <> b")
    out = materialize(met.unionByName(stars).distinct(), "linked")
    release(keyed)
    return out


def link(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, kept for each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = materialize(docs.mapInArrow(K.tidy(_prints(k)), "doc_id long, fp long"), "simhash")
    total = base.count()
    sets = materialize(base.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("size")), "prints")
    roots = components(linked(sets.filter("id IS NOT NULL")))
    named = sets.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("fp", "size", F.coalesce("root", "id").alias("component_id"))
    rows = join_groups(base, named, "fp", "size", total)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

"""Near-duplicate detection with an LSH forest over MinHash signatures.

Rows with the same set of word shingles collapse to one set first. Each set's signature is put
into ``TREES`` sorted orders, each beginning at another slot; an order is range-partitioned over the whole key, so
no prefix, however common, gathers in one task. In each order every set meets the ``REACH`` next ones, those with the
longest common prefixes, whatever its depth is there; rows at the border of two tasks meet by a join on the border. A
small sketch drops chance neighbours; pairs that are left are confirmed on the full sets: first chains and best
partners, then, after components are taken, every pair that still lies between two components. Last come crowds:
regions of an order whose rows share its first ``PREFIX`` slots, are too many to have all met and still hold several
components. Their sets are joined exactly, once, whatever number of orders they are crowded in: each set's shingles are
put in order of how rare they are among the crowded sets, and two sets can only be linked if they share one of the
rarest ``100 - percent`` percent, of which the smaller set shows about half. What a crowd has in common comes last in that order,
so sets that share a template and stay apart don't meet; of those that do, sizes and the places of the shared
shingle rule out most. So each pair that shares the first ``PREFIX`` slots of any order is found, however many others
share them. Rows of a shingle that many show are dealt over blocks of ``ROWS``.

Defined results: a text without words, or null, has the empty set and is linked with nothing; with fewer words
than ``k``, the whole sequence is one shingle; rows that repeat an id are one document; rows without
an id share the component of their text if another row has it, else they stay and have none; of a very long text the
whole set of shingle hashes, eight bytes each, is held by one task at a time; an empty table gives an empty table; other
columns pass untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K
from weftgraph.llm.bloom import members
from weftgraph.llm.graph import components
from weftgraph.llm.storage import free_name, join_groups, materialize

SLOTS, TREES, DEPTH, PREFIX, REACH, SKETCH = 96, 24, 8, 6, 8, 64
#: Rows of one shingle that a block of a crowd's join holds, about, and the logarithm of the most counts of shingles (8 MB).
ROWS, CELLS = 2048, 20
_U = np.uint64
_R = np.random.default_rng(424243)
_XOR, _MUL = (_R.integers(0, 1 << 63, SLOTS, dtype=np.int64).astype(_U) * _U(2) + _U(1) for _ in range(2))
#: The slots of each tree's key.
_PICK = (np.arange(TREES)[:, None] * (SLOTS // TREES) + np.arange(DEPTH)) % SLOTS


def shingle_sets(block: K.Block, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Each document's sorted distinct shingle hashes, and their counts."""
    w = K.words(block, K.SOLID, K.FOLDED)
    rolled = K.rolling(w.hash, k)
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(K.rolling(w.hash[a:b], b - a) ^ _U(b - a))
        else:
            out.append(np.empty(0, _U))
    return out, np.fromiter(map(len, out), np.int64, len(out))


def signatures(sets: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SLOTS 16-bit MinHash values of each non-empty set, and two hashes that identify it."""
    x = np.concatenate(sets)
    first = np.cumsum(n) - n
    sig = np.empty((len(n), SLOTS), np.uint16)
    for i in range(SLOTS):
        low = np.minimum.reduceat((x ^ _XOR[i]) * _MUL[i], first)
        sig[:, i] = K.mix(low + _U(i)) >> _U(48)
    return sig, np.add.reduceat(K.mix(x + _U(1)), first), np.add.reduceat(K.mix(x ^ _U(0x5555555555555555)), first)


def _features(k: int):
    def run(batches):
        for b in batches:
            ids, sizes, keys, sigs = b.column(0), [], [], []
            for block in K.blocks(K.encoded(b.column(1))):
                sets, n = shingle_sets(block, k)
                full = np.flatnonzero(n)
                key, sig = [None] * len(n), [None] * len(n)
                if len(full):
                    s, one, two = signatures([sets[i] for i in full], n[full])
                    both = np.stack([one, two], axis=1)
                    for j, i in enumerate(full.tolist()):
                        key[i], sig[i] = both[j].tobytes(), s[j].astype(">u2").tobytes()
                sizes.append(n)
                keys += key
                sigs += sig
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n", "key", "sig"])

    return run


def _orders(batches):
    """A row for each set and tree: the tree's key, and the sketch."""
    weight = _U(1) << np.arange(0, 64, 2, dtype=_U)
    for b in batches:
        sig = np.frombuffer(b"".join(b.column(2).to_pylist()), ">u2").reshape(-1, SLOTS)
        two = (sig[:, :SKETCH] & 3).astype(_U).reshape(-1, SKETCH // 32, 32)
        sketch = (two * weight).sum(axis=2, dtype=_U).astype(np.int64)
        for t in range(TREES):
            key = np.ascontiguousarray(sig[:, _PICK[t]]).tobytes()
            keys = pa.Array.from_buffers(pa.binary(2 * DEPTH), len(sig), [None, pa.py_buffer(key)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t), pa.int32()), keys, pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), b.column(0), b.column(1)], ["tree", "key", "s0", "s1", "id", "n"])


def _plausible(s0, s1, i, j, n, percent):
    """Whether rows i and j may be linked: by their sizes, and by their sketches with 4.5 deviations to spare."""
    share = percent / 100
    expect = share + (1 - share) / 4
    most = SKETCH * (1 - expect) + 4.5 * np.sqrt(SKETCH * expect * (1 - expect))
    half = _U(0x5555555555555555)
    off = np.zeros(len(i), np.int64)
    for s in (s0, s1):
        x = s[i] ^ s[j]
        off += np.bitwise_count((x | x >> _U(1)) & half)
    a, b = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    return (off <= most) & (100 * a >= percent * b), off


_PAIR = "a long, b long, off long, near boolean, tree int, part long, place long, key binary, s0 long, s1 long, n long"


def _neighbours(percent: int):
    """Plausible pairs of rows that stand near each other in an order; the first and last rows of a task too,
    for pairs across tasks."""

    def pairs(table):
        tree, s0, s1, ids, n = (table[x].to_numpy() for x in ("tree", "s0", "s1", "id", "n"))
        s0, s1 = s0.astype(_U), s1.astype(_U)
        first = np.array([x[:2] for x in table["key"].to_pylist()], "S2") if len(table) else np.empty(0, "S2")
        found = []
        for d in range(1, REACH + 1):
            i = np.arange(max(0, len(ids) - d))
            i = i[(tree[i] == tree[i + d]) & (first[i] == first[i + d]) & (ids[i] != ids[i + d])]
            ok, off = _plausible(s0, s1, i, i + d, n, percent)
            i, off = i[ok], off[ok]
            found.append((np.minimum(ids[i], ids[i + d]), np.maximum(ids[i], ids[i + d]), off, np.full(len(i), d == 1) & (tree[i] < 3)))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def rows(a, b, off, near):
        m = len(a)
        none = lambda t: pa.nulls(m, t)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(off, pa.int64()), pa.array(near, pa.bool_()), none(pa.int32()), none(pa.int64()), none(pa.int64()), none(pa.binary()), none(pa.int64()), none(pa.int64()), none(pa.int64())], _NAMES)

    def run(batches):
        part, place, tail, head = TaskContext.get().partitionId(), 0, None, []
        for b in batches:
            if not b.num_rows:
                continue
            now = pa.Table.from_batches([b])
            table = now if tail is None else pa.concat_tables([tail, now])
            yield rows(*pairs(table))  # pairs of two rows of the tail come again; they are made distinct later
            if place < REACH:
                head.append(now.slice(0, REACH - place))
            place += b.num_rows
            tail = table.slice(max(0, len(table) - REACH))
        if place:
            ends = pa.concat_tables([*head, tail]).combine_chunks()
            m, h = len(ends), sum(map(len, head))
            where = np.concatenate([np.arange(h), np.arange(place - (m - h), place)])
            none = lambda t: pa.nulls(m, t)
            col = lambda x: ends[x].combine_chunks()
            cols = [col("id"), none(pa.int64()), none(pa.int64()), none(pa.bool_()), col("tree"), pa.array(np.full(m, part), pa.int64()), pa.array(where, pa.int64()), col("key"), col("s0"), col("s1"), col("n")]
            yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], _NAMES)

    def across(table: pa.Table) -> pa.Table:
        """Pairs over one border, of the rows that end one task and those that begin the next."""
        table = table.sort_by([("part", "ascending"), ("place", "ascending")])
        return pa.Table.from_batches([rows(*pairs(table.rename_columns(["id", *table.column_names[1:]])))])

    return run, across


_NAMES = [x.split()[0] for x in _PAIR.split(", ")]


def _borders(counts: dict[int, int]) -> list[tuple[int, int, bool]]:
    """(border, task, whether its last rows) of the rows that meet over the borders of tasks with ``counts`` rows each.
    Past a task with fewer rows than the reach, the next one's first rows come too."""
    parts = sorted(counts)
    out = []
    for i, p in enumerate(parts[:-1]):
        out.append((p, p, True))
        met = 0
        for q in parts[i + 1 :]:
            out.append((p, q, False))
            met += counts[q]
            if met >= REACH:
                break
    return out


def candidates(sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a < b of ``sets`` (id, n, sig), their sketches' distance, and whether they are next to each other early on."""
    orders = sets.select("id", "n", "sig").mapInArrow(K.tidy(_orders), "tree int, key binary, s0 long, s1 long, id long, n long")
    run, across = _neighbours(percent)
    met = materialize(orders.repartitionByRange("tree", "key", "s0", "s1", "id").sortWithinPartitions("tree", "key", "s0", "s1", "id").mapInArrow(K.tidy(run), _PAIR), "forest")
    ends, pairs = met.filter("b IS NULL"), met.filter("b IS NOT NULL")
    counts = {r["part"]: r["n"] for r in ends.groupBy("part").agg((F.max("place") + 1).alias("n")).collect()}  # a number for each task
    borders = _borders(counts)
    if borders:
        meets = F.broadcast(met.sparkSession.createDataFrame([(g, p, last, counts[p]) for g, p, last in borders], "border long, at long, last boolean, rows long"))
        side = F.when(F.col("last"), F.col("place") >= F.col("rows") - REACH).otherwise(F.col("place") < REACH)
        over = ends.join(meets, F.col("part") == F.col("at")).filter(side).select("border", *_NAMES).dropDuplicates(["border", "part", "place"])
        pairs = pairs.unionByName(over.groupBy("border").applyInArrow(lambda t: across(t.drop(["border"])), _PAIR))
    return pairs.groupBy("a", "b").agg(F.min("off").alias("off"), F.max("near").alias("near"))


def _full_sets(k: int):
    def run(batches):
        for b in batches:
            out = []
            for block in K.blocks(K.encoded(b.column(1))):
                out += [s.tobytes() for s in shingle_sets(block, k)[0]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "items"])

    return run


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                m = len(np.intersect1d(np.frombuffer(x, _U), np.frombuffer(y, _U), assume_unique=True))
                ok.append(100 * m >= percent * (len(x) // 8 + len(y) // 8 - m))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def full_sets(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(id, items) of the documents named by ``ids`` (id)."""
    hashed = materialize(ids.withColumn("h", F.xxhash64("id")), "ends")
    asked = docs.filter(members(hashed, hashed.count()).test(F.xxhash64("doc_id")))
    return materialize(asked.select("doc_id", "text").mapInArrow(K.tidy(_full_sets(k)), "id long, items binary").join(hashed.select("id"), "id", "left_semi"), "sets")


def confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The ``pairs`` whose documents' full sets are similar enough."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    return similar(pairs, full_sets(ends, docs, k), percent)


def similar(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` whose sets in ``full`` (id, items) are similar enough."""
    one, two = full.select(F.col("id").alias("a"), F.col("items").alias("x")), full.select(F.col("id").alias("b"), F.col("items").alias("y"))
    met = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return met.mapInArrow(K.tidy(_confirm(percent)), "a long, b long").distinct()


def _regions(batches):
    """A row for each set and tree: a hash of the tree and the key's first PREFIX slots."""
    for b in batches:
        sig = np.frombuffer(b"".join(b.column(3).to_pylist()), ">u2").reshape(-1, SLOTS)
        for t in range(TREES):
            region = np.full(len(sig), t + 1, _U)
            for slot in _PICK[t, :PREFIX]:
                region = K.mix((region << _U(16) | region >> _U(48)) ^ sig[:, slot].astype(_U))
            yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), b.column(0), b.column(1), b.column(2)], ["region", "id", "n", "root"])


def _flat(items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a column without nulls, one after another, and where each begins and ends."""
    ends = np.frombuffer(items.buffers()[1], np.int32)[items.offset : items.offset + len(items) + 1]
    return np.frombuffer(items.buffers()[2], _U, (int(ends[-1]) - int(ends[0])) // 8, int(ends[0])), (ends - ends[0]) // 8


def _cells(x: np.ndarray, bits: int) -> np.ndarray:
    return (x * _U(0x9E3779B97F4A7C15) >> _U(64 - bits)).astype(np.int64)


def _counted(bits: int):
    def run(batches):
        """A task's counts of shingles, by cell."""
        seen = np.zeros(1 << bits, np.int64)
        for b in batches:
            if b.num_rows:
                x = _flat(b.column(0))[0]
                for at in range(0, len(x), 1 << 20):
                    seen += np.bincount(_cells(x[at : at + (1 << 20)], bits), minlength=1 << bits)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["cell", "n"])

    return run


def _rarest(percent: int, bits: int, counts):
    def run(batches):
        """The rarest shingles of each set, one of which it must share with any set that it is linked with."""
        seen = counts.value
        for b in batches:
            if not b.num_rows:
                continue
            x, ends = _flat(b.column(1))
            often = seen[_cells(x, bits)]
            sizes = np.diff(ends)
            shown = sizes - -(-percent * sizes // 100) + 1
            took = [lo + np.lexsort((x[lo:hi], often[lo:hi]))[:m] for lo, hi, m in zip(ends[:-1].tolist(), ends[1:].tolist(), shown.tolist(), strict=True)]
            row = np.repeat(np.arange(len(sizes)), shown)
            place = np.arange(len(row)) - np.repeat(np.cumsum(shown) - shown, shown) + 1
            ids, root = b.column(0).to_numpy(), b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x[np.concatenate(took)].view(np.int64)), pa.array(ids[row]), pa.array(sizes[row].astype(np.int64)), pa.array(place), pa.array(root[row])], ["item", "id", "n", "place", "root"])

    return run


def rare_pairs(full: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``full`` (id, items, root) from two components that may be similar enough, none that is left out: a < b, the components' ``low`` < ``high``,
    and ``most``, a bound on the similarity in millionths."""
    weight = full.agg(F.sum(F.length("items") / 8)).first()[0] or 0
    bits = min(CELLS, max(10, int(weight).bit_length()))
    table = full.select("items").mapInArrow(K.tidy(_counted(bits)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # 2**bits rows at most
    counts = np.zeros(1 << bits, np.int64)
    counts[table["cell"].to_numpy()] = table["n"].to_numpy()
    sent = full.sparkSession.sparkContext.broadcast(counts)
    shown = materialize(full.select("id", "items", "root").mapInArrow(K.tidy(_rarest(percent, bits, sent)), "item long, id long, n long, place long, root long"), "rarest")
    # The smaller set of a pair shows fewer: at least so much of it is in the larger one.
    early = F.col("place") <= F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / F.lit(100 + percent)) + 1
    groups = shown.groupBy("item").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("low"), F.max("root").alias("high"), F.max(early).alias("early"))
    groups = materialize(groups.filter("early AND low < high").select("item", "m", F.ceil(F.col("m") / ROWS).cast("int").alias("blocks")), "shown")
    n, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("m"), F.lit(0))).first()
    plane = members(groups.select(F.col("item").alias("h")), n)
    met = materialize(join_groups(shown.filter(plane.test("item")), groups, "item", "m", total), "met")
    own, others = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = met.filter(early).withColumn("at", own).withColumn("to", others).select("item", "at", "to", *(F.col(c).alias(f"{c}1") for c in ("id", "n", "place", "root")))
    two = met.withColumn("to", own).withColumn("at", others).select("item", "at", "to", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "place", "root")))
    most = 1 + F.least(F.expr("n1 - place1"), F.expr("n2 - place2"))
    fits = F.expr(f"root1 <> root2 AND (n1 < n2 OR n1 = n2 AND id1 < id2) AND 100 * n1 >= {percent} * n2") & ((100 + percent) * most >= percent * F.expr("n1 + n2"))
    pairs = one.join(two, ["item", "at", "to"]).filter(fits).select(
        F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"), F.least("root1", "root2").alias("low"), F.greatest("root1", "root2").alias("high"), (1000000 * most / F.expr("n1 + n2")).cast("long").alias("most")
    )
    return pairs.groupBy("a", "b", "low", "high").agg(F.max("most").alias("most"))


def crowd_links(sets: DataFrame, roots: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Links between components within regions of more rows than have all met; None where there is no such region."""
    named = sets.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("id", "n", F.coalesce("root", "id").alias("root"), "sig")
    rows = named.mapInArrow(K.tidy(_regions), "region long, id long, n long, root long")
    counted = rows.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("low"), F.max("root").alias("high"))
    crowds = materialize(counted.filter(f"m > {REACH + 1} AND low < high").select("region", "m"), "crowds")
    n, total = crowds.agg(F.count(F.lit(1)), F.sum("m")).first()
    if not n:
        return None
    # A set is asked once for each order, so chance alone would let many of them through the filter: the join says which are crowded.
    asked = rows.filter(members(crowds.select(F.col("region").alias("h")), n).test("region")).select("region", "id", "root")
    met = materialize(join_groups(asked, crowds, "region", "m", total).select("id", "root").distinct(), "crowded")
    full = full_sets(met.select("id"), docs, k)
    pairs = materialize(rare_pairs(full.join(met, "id"), percent), "pairs")
    # One pair for each two components first; then what still lies between two.
    best = materialize(pairs.groupBy("low", "high").agg(F.max(F.struct("most", "a", "b")).alias("best")).select("best.a", "best.b", "low", "high"), "early")
    links = materialize(similar(best, full, percent), "linked")
    now = components(best.join(links, ["a", "b"]).select("low", "high"))
    rest = pairs.select("a", "b", "low", "high").join(best.select("a", "b"), ["a", "b"], "left_anti")
    for side in ("low", "high"):
        rest = rest.join(now.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), side, "left").withColumn(side, F.coalesce(f"{side}_root", side)).drop(f"{side}_root")
    return links.unionByName(materialize(similar(rest.filter("low <> high").select("a", "b"), full, percent), "linked"))


def link(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = materialize(docs.mapInArrow(K.tidy(_features(k)), "doc_id long, n long, key binary, sig binary"), "minhash")
    total = base.count()
    sets = materialize(base.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("sig").alias("sig")), "sets")
    pairs = materialize(candidates(sets.filter("id IS NOT NULL"), percent), "pairs")
    # Chains along an order and each set's best partner connect most of what belongs together.
    best = pairs.select(F.col("a").alias("id"), "a", "b", "off").unionByName(pairs.select(F.col("b").alias("id"), "a", "b", "off")).groupBy("id").agg(F.min(F.struct("off", "a", "b")).alias("best")).select("best.a", "best.b")
    early = materialize(pairs.filter("near").select("a", "b").unionByName(best).distinct(), "early")
    links = materialize(confirm(early, docs, k, percent), "linked")
    roots = components(links)
    rest = pairs.select("a", "b").join(early, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        rest = rest.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    rest = materialize(rest.filter("root_a <> root_b").select("a", "b"), "rest")
    if not rest.isEmpty():
        links = materialize(links.unionByName(confirm(rest, docs, k, percent)), "linked")
        roots = components(links)
    crowd = crowd_links(sets.filter("id IS NOT NULL").select("id", "n", "sig"), roots, docs, k, percent)
    if crowd is not None and not crowd.isEmpty():
        roots = components(links.unionByName(crowd))
    named = sets.select("key", "id", "size").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("key", "size", F.coalesce("root", "id").alias("component_id"))
    rows = join_groups(base.filter("n > 0").select("key", "doc_id", "n"), named, "key", "size", total).select("doc_id", "n", "component_id")
    rows = rows.unionByName(base.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest id."""
    out = link(docs, k, percent)
    h, lost = (free_name(docs.columns, x) for x in ("_h", "gone"))
    gone = materialize(out.filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(lost)).distinct(), "gone")
    plane = members(gone.select(F.xxhash64(lost).alias("h")), gone.count())
    marked = docs.withColumn(h, F.coalesce(plane.test(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))), F.lit(False)))
    stay = marked.filter(~F.col(h)).unionByName(marked.filter(h).join(gone, F.col("doc_id") == F.col(lost), "left_anti"))
    return stay.select(*docs.columns)

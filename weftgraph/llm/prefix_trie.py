"""The trie of conversations that share their first turns, rolled up to every prefix by pointer jumping.

A prefix is named by a digest of its turns, D(turns, t) = D(turns) * BASE + t modulo the prime 2**127 - 1, t being 127 bits
of a turn's role and text. Digests of neighbouring stretches combine, so turns are range-partitioned over (conversation, turn)
whatever a conversation's length: each task digests its rows, and one row a task carries ranks and digests over the borders.
For the same reason a conversation whose first turns are replaced needs no second pass over its turns: one difference of
digests, times a power of BASE, moves all later ones.

Nodes are grouped by digest and have their parent's digest as an edge. Leaves and savings then go to all ancestors in doubling
rounds: after round r a node holds what lies less than 2**r levels below and points to its ancestor 2**r levels above, so
the rounds are the logarithm of the longest conversation's length. Nodes that point past the root drop out.

Defined results: rows without conv_id belong to no conversation; null role or text is empty; a null turn comes first; rows of
one turn are in the order of their digests (MD5 of role's MD5 and text's MD5, in hex), repeated rows are turns of their own;
texts of any length count with all their words and shuffle as digests alone; an empty table gives an empty table; other
columns aren't read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K
from weftgraph.llm.storage import join_groups, materialize, release

#: The rebuilt conversations: turns replaced at most, less one, and conversations that take theirs from one.
HEADS, FAMILY = 4, 20
#: Ids that one row holds on their way into a hash.
IDS = 4096
P, BASE = (1 << 127) - 1, 0x3C6EF372FE94F82BA54FF53A5F1D36F1
#: The digest of no turns.
ROOT = 1


def _put(x: int) -> bytes:
    return x.to_bytes(16, "big")


def _got(x: bytes) -> int:
    return int.from_bytes(x, "big")


@lru_cache(1 << 16)
def _power(n: int) -> int:
    return pow(BASE, n, P)


_SCANNED = "kind int, part int, conv_id long, rank long, digest binary, before binary, words long"
#: A turn of the task's first conversation, a turn of another, the sum of the first, and of the last conversation.
OPEN, WHOLE, FIRST, LAST = 0, 1, 2, 3


def _scan(batches):
    """Ranks and digests within a task, and rows that sum up its first and last conversation."""
    part, names = TaskContext.get().partitionId(), [x.split()[0] for x in _SCANNED.split(", ")]
    conv, rank, digest, kind, sums = None, 0, 0, OPEN, []

    def rows(out):
        cols = list(zip(*out, strict=True)) if out else [()] * 7
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    for b in batches:
        out = []
        for c, mark, words in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if c != conv:
                if conv is not None:
                    if kind == OPEN:
                        sums.append((FIRST, part, conv, rank, _put(digest), None, None))
                    kind = WHOLE
                conv, rank, digest = c, 0, 0 if kind == OPEN else ROOT
            before, digest, rank = digest, (digest * BASE + int(mark, 16)) % P, rank + 1
            out.append((kind, part, c, rank, _put(digest), _put(before), words))
        yield rows(out)
    if conv is not None:
        sums.append((FIRST if kind == OPEN else LAST, part, conv, rank, _put(digest), None, None))
        yield rows(sums)


def _starts(sums: list) -> dict[int, tuple[int, int]]:
    """Rank and digest that each task's first conversation has reached in the tasks before."""
    out, reached = {}, (None, 0, ROOT)
    for s in sorted(sums, key=lambda s: (s["part"], s["kind"])):
        rank, digest = s["rank"], _got(s["digest"])
        if s["kind"] == FIRST:
            n, d = reached[1:] if reached[0] == s["conv_id"] else (0, ROOT)
            out[s["part"]] = n, d
            rank, digest = n + rank, (d * _power(rank) + digest) % P
        reached = s["conv_id"], rank, digest
    return out


def _carried(starts: dict[int, tuple[int, int]]):
    """Rows of the tasks' first conversations, with what went before."""

    def run(batches):
        for b in batches:
            part, rank, digest, before = (b.column(x).to_pylist() for x in ("part", "rank", "digest", "before"))
            to = [starts[p] for p in part]
            moved = [(d * _power(r) + _got(x)) % P for (_, d), r, x in zip(to, rank, digest, strict=True)]
            older = [(d * _power(r - 1) + _got(x)) % P for (_, d), r, x in zip(to, rank, before, strict=True)]
            ranks = [n + r for (n, _), r in zip(to, rank, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(ranks, pa.int64()), pa.array(map(_put, moved), pa.binary()), pa.array(map(_put, older), pa.binary()), b.column("words")], ["conv_id", "rank", "digest", "before", "words"])

    return run


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id, rank (from 1), digest, before, words: every turn, the prefix that it ends, and the one that it follows."""
    text, role = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("text", "role"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat(F.md5(role), F.md5(text))).alias("mark"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    marks = materialize(rows, "turns")
    # Equal rows are dealt too: which of them comes first makes no difference.
    order = ["conv_id", F.col("turn").asc_nulls_first(), "mark", "deal"]
    dealt = marks.withColumn("deal", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    scanned = materialize(dealt.select("conv_id", "mark", "words").mapInArrow(K.tidy(_scan), _SCANNED), "scanned")
    release(marks)
    starts = _starts(scanned.filter(F.col("kind") >= FIRST).collect())  # two rows a task
    names = ["conv_id", "rank", "digest", "before", "words"]
    moved = scanned.filter(F.col("kind") == OPEN).mapInArrow(K.tidy(_carried(starts)), "conv_id long, rank long, digest binary, before binary, words long")
    return scanned.filter(F.col("kind") == WHOLE).select(*names).unionByName(moved)


def taken(conv_id: Column) -> Column:
    """How many first turns a conversation takes over."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("long")


def families(turns: DataFrame) -> DataFrame:
    """A row for each conversation: n (own turns), h and k (first turns lost, and taken over), length, the digest of its own
    first h turns and of the k that replace them, and these."""
    root = F.lit(_put(ROOT))
    counted = turns.groupBy("conv_id").agg(F.max("rank").alias("n"))
    heads = turns.filter(F.col("rank") < HEADS).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("rank", "digest", "before", "words"))).alias("heads"))  # HEADS - 1 at most
    convs = materialize(counted.join(heads, "conv_id"), "convs")
    base = convs.select(F.col("conv_id").alias("base"), F.col("heads").alias("theirs"))
    named = convs.withColumn("h", taken(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(base, "base", "left")
    end = lambda xs, i: F.when(i > 0, F.try_element_at(xs, i.cast("int"))["digest"]).otherwise(root)
    named = named.withColumn("k", F.least("h", F.coalesce(F.size("theirs"), F.lit(0)).cast("long")))
    named = named.withColumn("k", F.when(F.col("theirs").isNull(), 0).otherwise(F.col("k")))
    return named.select("conv_id", "n", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"), end(F.col("heads"), F.least("h", "n")).alias("own"), end(F.col("theirs"), F.col("k")).alias("top"), F.when(F.col("k") > 0, F.slice("theirs", F.lit(1), F.col("k").cast("int"))).alias("theirs"))


def _moved(batches):
    """Own turns of rebuilt conversations: their digests with the first turns replaced."""
    for b in batches:
        past, own, top, digest, before = (b.column(x).to_pylist() for x in ("past", "own", "top", "digest", "before"))
        by = [(_got(t) - _got(o)) % P for t, o in zip(top, own, strict=True)]
        new = [_put((_got(x) + d * _power(p)) % P) for x, d, p in zip(digest, by, past, strict=True)]
        old = [_put((_got(x) + d * _power(p - 1)) % P) for x, d, p in zip(before, by, past, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("depth"), b.column("last"), pa.array(new, pa.binary()), pa.array(old, pa.binary()), b.column("words")], ["conv_id", "depth", "last", "digest", "parent", "words"])


def members(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, last, digest, parent, words: every prefix but the root of every rebuilt conversation."""
    theirs = convs.select("conv_id", "length", F.explode("theirs").alias("x")).select("conv_id", F.col("x.rank").alias("depth"), (F.col("x.rank") == F.col("length")).alias("last"), "x.digest", F.col("x.before").alias("parent"), "x.words")
    total = convs.agg(F.sum("n")).first()[0] or 0
    own = join_groups(turns.filter(F.col("rank") > taken(F.col("conv_id"))), convs.filter("n > h").drop("theirs"), "conv_id", "n", total)
    own = own.withColumn("past", F.col("rank") - F.col("h")).withColumn("depth", F.col("past") + F.col("k"))
    own = own.select("conv_id", "depth", (F.col("depth") == F.col("length")).alias("last"), "past", "own", "top", "digest", "before", "words")
    return theirs.unionByName(own.mapInArrow(K.tidy(_moved), "conv_id long, depth long, last boolean, digest binary, parent binary, words long"))


def _listed(batches):
    """Sorted ids of each node, some thousand in a row."""
    node, first, ids, out = None, 0, [], []
    for b in batches:
        for d, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if d != node or len(ids) == IDS:
                if ids:
                    out.append((node, first, ",".join(ids)))
                node, first, ids = d, c, []
            ids.append(str(c))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string()))], ["digest", "first", "ids"])
        out = []
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], ["digest", "first", "ids"])


def _hashed(batches):
    """One hash over each node's lists, read in order and not kept."""
    node, h, out = None, None, []
    for b in batches:
        for d, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if d != node:
                if node is not None:
                    out.append((node, h.hexdigest()))
                node, h = d, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], ["digest", "ends_sha256"])
        out = []
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()])], ["digest", "ends_sha256"])


def ends(last: DataFrame) -> DataFrame:
    """digest, ends_sha256 of the nodes at which the conversations of ``last`` (digest, conv_id) end."""
    lists = last.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(K.tidy(_listed), "digest binary, first long, ids string")
    return lists.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(K.tidy(_hashed), "digest binary, ends_sha256 string")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """digest, n_leaves, saved_tokens over whole subtrees of ``nodes`` (digest, depth, parent, leaves, saved)."""
    deepest, total = nodes.agg(F.max("depth"), F.count(F.lit(1))).first()
    state = materialize(nodes.select("digest", "depth", F.col("parent").alias("up"), "leaves", "saved"), "rolled")
    step = 1
    while step <= (deepest or 0):
        below = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("digest")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.count(F.lit(1)).alias("size"))
        summed = materialize(state.join(below, "digest", "left").select("digest", "depth", "up", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), F.coalesce("size", F.lit(0)).alias("size")), "summed")
        names = ["digest", "depth", "leaves", "saved"]
        # The ancestor two steps up is the root at a depth of two steps, and lies past it above.
        near = summed.filter(F.col("depth") <= 2 * step).select(*names, F.when(F.col("depth") == 2 * step, F.lit(_put(ROOT))).alias("up"))
        above = summed.filter("size > 0").select(F.col("digest").alias("up"), F.col("up").alias("next"), "size")
        far = join_groups(summed.filter(F.col("depth") > 2 * step).select(*names, "up"), above, "up", "size", total).select(*names, F.col("next").alias("up"))
        older, state = state, materialize(near.unionByName(far), "rolled")
        release(older, summed)
        step *= 2
    return state.select("digest", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node."""
    turns = digested(conversations)
    convs = materialize(families(turns), "families")
    met = materialize(members(turns, convs), "members")
    root = F.lit(_put(ROOT))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    grouped = met.groupBy("digest", "depth", "parent", "words").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    grouped = grouped.unionByName(top.select(root.alias("digest"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"), "conv_id", "n_convs"))
    grouped = materialize(grouped, "nodes")
    children = grouped.filter("depth > 0").groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(grouped.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    release(grouped)
    first, total = nodes.agg(F.min(F.when(F.col("depth") == 0, F.col("conv_id"))), F.count(F.lit(1))).first()
    sums = rolled_up(nodes.select("digest", "depth", "parent", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")))
    over = nodes.filter("n_children > 0").select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("size"))
    names = ["digest", "conv_id", "depth", "n_convs", "n_children"]
    deep = join_groups(nodes.filter("depth > 1").select(*names, "parent"), over, "parent", "size", total).select(*names, "parent_conv_id")
    shallow = nodes.filter("depth <= 1").select(*names, F.when(F.col("depth") == 1, F.lit(first)).cast("long").alias("parent_conv_id"))
    closed = ends(met.filter("last").select("digest", "conv_id").unionByName(convs.filter("length = 0").select(root.alias("digest"), "conv_id")))
    out = shallow.unionByName(deep).join(sums, "digest").join(closed, "digest", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))

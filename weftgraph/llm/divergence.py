"""How each source's choice of terms differs from the other sources of its language, and which terms set it apart.

A tournament over blocks of sources. Terms of a language are cut into slices, sources into players; the vectors of one player's
sources over one slice, compressed, are a block. Blocks stay in their partitions, which are persisted under the key that all rounds
join on; in each round of a round-robin schedule half of the players travel to the other half's partitions, each meeting
compares all sources of the one with all of the other and gives both directions, so every two players meet once and only
visitors shuffle. The first round is played at home: sources of one player among themselves, and each against its whole
language, where a heap for each source and slice keeps the ``TOP`` terms that it prefers most. Differences add up over slices.

Counts are exact: occurrences and documents are counted in the tasks that read the texts, then by (language, source, term), so that a
hot source, language or term is summed before it shuffles. Shares are whole numbers, p = 1 + floor(10**9 * (count + 5) / (N + 5 V)).
A term that a source lacks costs nothing: two sources' shares of absent terms differ by one number, taken times V at slice 0.

Defined results: null text, language or source is ''; a group without terms has shares like any other; a language that keeps no
term has pairs of value 0 and no terms; repeated rows count as documents of their own; of a long text, ``PIECE`` bytes are
cut into terms at a time; an empty table gives an empty table; other columns, doc_id too, aren't read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K
from weftgraph.llm.storage import join_groups, materialize, release

#: Documents of its language that a kept term stands in, weight of an unseen occurrence, scale of shares, terms listed for a source.
LEAST, EXTRA, SCALE, TOP = 30, 5, 10**9, 50
#: Terms of a slice, about; sources of a player at most, about; players of a language that has as many sources; rounds in one job at most.
SLICE, BLOCK, PLAYERS, LEG = 4096, 64, 4, 8
#: Bytes of text cut into terms at a time, and counts that a task holds before it passes them on.
PIECE, HELD = 1 << 20, 400_000
#: Bytes of terms stay (A-Z as a-z), all others become blanks.
_TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _pieces(text: bytes):
    """Lists of terms of parts of a text, cut between terms."""
    at = 0
    while at < len(text):
        to = text.find(b" ", at + PIECE)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


_COUNTED = ["lang", "source", "term", "n", "d"]


def _count(batches):
    """Occurrences and documents of each term of a task's groups, and a row without term for each group."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows():
        for (lang, source), (n, d) in seen.items():
            terms = list(n)
            m = len(terms) + 1
            yield pa.RecordBatch.from_arrays([pa.array([lang] * m), pa.array([source] * m), pa.array([*terms, None], pa.binary()).cast(pa.string()), pa.array([*n.values(), 0], pa.int64()), pa.array([*(d[t] for t in terms), 0], pa.int64())], _COUNTED)
        seen.clear()

    for b in batches:
        for text, lang, source in zip(K.encoded(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            n, d = seen.setdefault((lang, source), (Counter(), Counter()))
            once: set[bytes] = set()
            for terms in _pieces(text.translate(_TERMS)):
                n.update(terms)
                once.update(terms)
            d.update(once)
        if sum(len(n) for n, _ in seen.values()) > HELD:
            yield from rows()
    yield from rows()


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents), and a row with a null term for each group."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = docs.select(text("text"), text("lang"), text("source")).mapInArrow(K.tidy(_count), "lang string, source string, term string, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def shares(n: np.ndarray, total: int, v: int) -> np.ndarray:
    """1 + floor(SCALE * (n + EXTRA) / (total + EXTRA * v)), exactly."""
    if not len(n):
        return np.empty(0, np.int64)
    if (int(n.max()) + EXTRA) * SCALE >= 1 << 63:
        return np.array([1 + SCALE * (int(x) + EXTRA) // (total + EXTRA * v) for x in n], np.int64)
    return 1 + SCALE * (n.astype(np.int64) + EXTRA) // (total + EXTRA * v)


def _pack(table: pa.Table) -> pa.Table:
    """One source's counts over one slice, compressed."""
    at, n = table["at"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(at)
    vec = zlib.compress(np.diff(at[order], prepend=0).astype("<u4").tobytes() + n[order].astype("<i8").tobytes(), 1)
    return pa.table({"lang": table["lang"].slice(0, 1), "slice": table["slice"].slice(0, 1), "source": table["source"].slice(0, 1), "n": pa.array([int(n.sum())], pa.int64()), "vec": pa.array([vec], pa.binary())})


def unpacked(vec: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of a vector."""
    raw = zlib.decompress(vec) if vec else b""
    m = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", m).astype(np.int64)), np.frombuffer(raw, "<i8", m, 4 * m)


class Vectors:
    """A block's shares: one for each place that any of the vectors has, and each source's share of a term it lacks."""

    def __init__(self, table: pa.Table):
        self.source, self.vecs = table["source"].to_pylist(), [unpacked(x) for x in table["vec"].to_pylist()]
        self.sizes = list(zip(table["total"].to_pylist(), table["v"].to_pylist(), strict=True))
        self.absent = [int(shares(np.zeros(1, np.int64), *s)[0]) if s[1] else 0 for s in self.sizes]
        self.width = max((int(at[-1]) + 1 for at, _ in self.vecs if len(at)), default=0)

    def row(self, i: int, width: int) -> np.ndarray:
        out = np.full(width, self.absent[i], np.int64)
        at, n = self.vecs[i]
        out[at] = shares(n, *self.sizes[i])
        return out


_MET = {"lang": pa.string(), "source": pa.string(), "part": pa.string(), "item": pa.string(), "value": pa.int64()}


def _met(lang: str, rows: list[tuple[str, str, str, int]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.table({"lang": pa.array([lang] * len(rows), pa.string())} | {k: pa.array(c, t) for (k, t), c in zip(list(_MET.items())[1:], cols, strict=True)})


def _differences(a: Vectors, b: Vectors, slice_: int, v: int, same: bool) -> list[tuple[str, str, str, int]]:
    """Both directions of every meeting of a's and b's sources over one slice."""
    width, out = max(a.width, b.width), []
    home = np.stack([a.row(i, width) for i in range(len(a.source))])
    lack = np.array(a.absent, np.int64)
    for j in range(len(b.source)):
        first = j + 1 if same else 0
        value = np.abs(home[first:] - b.row(j, width)).sum(axis=1) + ((v if slice_ == 0 else 0) - width) * np.abs(lack[first:] - b.absent[j])
        for i, x in zip(range(first, len(a.source)), value.tolist(), strict=True):
            out += [(a.source[i], "pair", b.source[j], x), (b.source[j], "pair", a.source[i], x)]
    return out


def _at_home(home: pa.Table, whole: pa.Table) -> pa.Table:
    """A player's sources among themselves, and the terms that each prefers to its language as a whole."""
    if not len(home):
        return _met("", [])
    a, v = Vectors(home), home["v"][0].as_py()
    out = _differences(a, a, home["slice"][0].as_py(), v, True)
    if len(whole):
        q = Vectors(whole)
        base, terms = q.row(0, q.width), np.array(whole["terms"][0].as_py(), object)
        for i, (at, n) in enumerate(a.vecs):
            f = shares(n, *a.sizes[i]) - base[at]
            more = np.flatnonzero(f > 0)
            if len(more) > TOP:  # all that tie with the last one stay until they are ranked
                more = more[f[more] >= np.partition(f[more], len(more) - TOP)[len(more) - TOP]]
            best = sorted(zip((-f[more]).tolist(), terms[at[more]], strict=True), key=lambda x: (x[0], x[1].encode()))[:TOP]
            out += [(a.source[i], "term", t, -x) for x, t in best]
    return _met(home["lang"][0].as_py(), out)


def _away(home: pa.Table, visitors: pa.Table) -> pa.Table:
    if not len(home) or not len(visitors):
        return _met("", [])
    return _met(home["lang"][0].as_py(), _differences(Vectors(home), Vectors(visitors), home["slice"][0].as_py(), home["v"][0].as_py(), False))


def partner(players: int, player: int, rnd: int) -> int:
    """Whom a player meets in round ``rnd`` (from 0) of a tournament of an even number of players."""
    last = players - 1
    return rnd if player == last else last if player == rnd else (2 * rnd - player) % last


def _visitors(residents: DataFrame, first: int, rounds: int) -> DataFrame:
    """Rows of the players who travel in the rounds from ``first`` on, under their hosts' numbers."""
    m, r, x = F.col("players"), F.col("round"), F.col("player")
    host = F.when(x == m - 1, r).when(x == r, m - 1).otherwise(F.pmod(2 * r - x, m - 1))
    away = residents.withColumn("round", F.explode(F.sequence(F.lit(first), F.lit(first + rounds - 1)))).filter(r < m - 1).withColumn("host", host)
    # Of two players the one hosts whose number is lower if their sum is even, else higher: hosting is spread evenly.
    return away.filter((F.col("host") < x) == ((F.col("host") + x) % 2 == 0)).select("lang", "slice", F.col("host").alias("player"), "source", "total", "v", "vec")


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) of ``docs`` (text, lang, source)."""
    spark = docs.sparkSession
    counted = materialize(counts(docs), "counts")
    kept = materialize(counted.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("d").alias("docs"), F.sum("n").alias("n")).filter(F.col("docs") >= LEAST).select("lang", "term", "n"), "kept")
    groups = counted.filter("term IS NULL").select("lang", "source")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("all")), "lang", "left")
    players = F.greatest(F.least("groups", F.lit(PLAYERS)), F.ceil(F.col("groups") / BLOCK))
    langs = materialize(langs.select("lang", "groups", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("all", F.lit(0)).alias("all"), F.greatest(F.lit(1), F.ceil(F.coalesce("v", F.lit(0)) / SLICE)).cast("int").alias("slices"), (players + players % 2).cast("int").alias("players")), "langs")
    n_groups, n_kept, most = langs.agg(F.sum("groups"), F.sum("v"), F.max("players")).first()
    place = Window.partitionBy("lang", "slice").orderBy("term")  # some SLICE terms
    terms = join_groups(kept, langs.filter("v > 0"), "lang", "v", n_kept or 0).select("lang", "term", F.col("n").alias("whole"), F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"))
    terms = materialize(terms.withColumn("at", F.row_number().over(place) - 1), "terms")
    packed = counted.filter("n > 0").select("lang", "source", "term", "n").join(terms.drop("whole"), ["lang", "term"]).select("lang", "slice", "source", "at", "n").groupBy("lang", "slice", "source").applyInArrow(_pack, "lang string, slice int, source string, n long, vec binary")
    packed = materialize(packed, "vectors")
    sums = packed.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = join_groups(groups.join(sums, ["lang", "source"], "left"), langs.select("lang", "groups", "v", "slices", "players"), "lang", "groups", n_groups or 0)
    each = named.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).join(packed.drop("n"), ["lang", "source", "slice"], "left")
    residents = materialize(each.select("lang", "slice", F.pmod(F.xxhash64("source"), F.col("players")).cast("int").alias("player"), "players", "source", F.coalesce("total", F.lit(0)).alias("total"), "v", "vec"), "residents")
    key = ["lang", "slice", "player"]
    stay = residents.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key).persist()
    schema = "lang string, source string, part string, item string, value long"
    listed = terms.groupBy("lang", "slice").agg(F.sort_array(F.collect_list(F.struct("at", "term", "whole"))).alias("x"))  # some SLICE terms
    whole = listed.join(langs, "lang").select("lang", "slice", F.explode(F.sequence(F.lit(0), F.col("players") - 1)).alias("player"), F.lit("").alias("source"), F.col("all").alias("total"), "v", F.col("x.term").alias("terms"), F.col("x.whole").alias("n"))
    whole = whole.mapInArrow(K.tidy(_language), "lang string, slice int, player int, source string, total long, v long, terms array<string>, vec binary")
    met = [materialize(stay.groupBy(*key).cogroup(whole.groupBy(*key)).applyInArrow(_at_home, schema), "home")]
    rounds = (most or 0) - 1
    leg = min(LEG, max(1, -(-rounds // LEG)))
    for first in range(0, rounds, leg):
        visitors = _visitors(stay, first, leg)
        met.append(materialize(stay.groupBy(*key).cogroup(visitors.groupBy(*key)).applyInArrow(_away, schema).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "away"))
    stay.unpersist()
    release(counted, kept, packed, residents)
    out = met[0]
    for more in met[1:]:
        out = out.unionByName(more)
    out = out.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # slices of a pair; a term stands in one
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return out.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= TOP))


def _language(batches):
    """Whole languages' counts over a slice as vectors, beside their terms."""
    for b in batches:
        vecs = [zlib.compress(np.diff(np.arange(len(n)), prepend=0).astype("<u4").tobytes() + np.array(n, "<i8").tobytes(), 1) for n in b.column("n").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("lang", "slice", "player", "source", "total", "v", "terms")), pa.array(vecs, pa.binary())], ["lang", "slice", "player", "source", "total", "v", "terms", "vec"])

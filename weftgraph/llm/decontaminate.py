"""Benchmark decontamination with an FM-index over each training shard.

A shard is what a task reads, up to ``HELD`` bytes of text or ``SHARD`` words of the benchmark's. Its words are mapped to
the benchmark's vocabulary; stretches too short to hold a window are left out, since no window can lie there. Over the
rest stands an FM-index: Burrows-Wheeler transform in a wavelet matrix, every ``SAMPLE``-th text position sampled.
All windows are searched backward at once through the matrix's ranks, their rows are located by
walking to the next sample, and overlapping hits merge into removal spans. Nothing shuffles. A benchmark is sent
to the tasks in passes of ``PASS_BYTES`` of text, whose windows take about seven times that.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one
window. Defined results: null or empty text has no words and no hit; an item without words has no
window; an empty benchmark hits nothing; rows that repeat an id are judged each on their own; item ids
are compared as strings; a very long text is a shard of its own; columns of ``docs`` with clashing names pass untouched.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K
from weftgraph.llm.storage import free_name, modest_batches

SAMPLE = 8
#: Symbols of one index, bytes of text that wait for it, and bytes of benchmark text that one pass sends to the tasks.
SHARD, HELD, PASS_BYTES = 1 << 20, 32 << 20, 2 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(range(256)).translate(bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))))


class WaveletMatrix:
    """Access and rank over integer symbols, for many positions at a time."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros, rest = [], [], symbols.astype(np.int32)
        for level in range(self.levels - 1, -1, -1):
            bit = (rest >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(rest) - int(self.ones[-1][-1]))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position ``at``."""
        low = np.zeros_like(at)
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            one, bit = self.ones[i], (symbol >> level) & 1 == 1
            a, b = one[low], one[at]
            low, at = np.where(bit, self.zeros[i] + a, low - a), np.where(bit, self.zeros[i] + b, at - b)
        return at - low

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and how often it stands before."""
        low, symbol = np.zeros_like(at), np.zeros_like(at)
        for i in range(self.levels):
            one = self.ones[i]
            a, b = one[low], one[at]
            bit = one[at + 1] > b
            symbol = symbol * 2 + bit
            low, at = np.where(bit, self.zeros[i] + a, low - a), np.where(bit, self.zeros[i] + b, at - b)
        return symbol, at - low


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; a shorter suffix comes before those it begins."""
    n, k = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        k *= 2


class FMIndex:
    """Counts and places of phrases in a sequence of symbols below ``sigma``; the last symbol, and no other, is 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        order = suffix_array(text)
        self.wavelet = WaveletMatrix(text[order - 1], sigma)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.rows = np.flatnonzero(order % SAMPLE == 0)
        self.sampled, self.n = order[self.rows], len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix rows [low, high) that begin with each phrase (one per row), matched from its last symbol on."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        live = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, column]
            low[live] = self.starts[c] + self.wavelet.rank(c, low[live])
            high[live] = self.starts[c] + self.wavelet.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, steps, out = rows.copy(), 0, np.full(len(rows), -1)
        open_ = np.arange(len(rows))
        while len(open_):
            slot = np.minimum(np.searchsorted(self.rows, at[open_]), len(self.rows) - 1)
            found = self.rows[slot] == at[open_]
            out[open_[found]] = self.sampled[slot[found]] + steps
            open_ = open_[~found]
            symbol, rank = self.wavelet.access_rank(at[open_])
            at[open_] = self.starts[symbol] + rank
            steps += 1
        return out


@dataclass
class Phrases:
    """The windows of some items: ``vocabulary`` holds sorted word hashes, symbols count from 2
    (0 ends a shard, 1 stands between stretches). Window i occurs in items ``owners[bounds[i] : bounds[i + 1]]``."""

    vocabulary: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]  # windows, and their numbers
    names: list[str]
    owners: np.ndarray
    bounds: np.ndarray

    @property
    def shortest(self) -> int:
        return min(self.by_length, default=0)

    def items(self, windows: np.ndarray) -> set[str]:
        found = np.unique(np.concatenate([self.owners[self.bounds[i] : self.bounds[i + 1]] for i in np.unique(windows).tolist()]))
        return {self.names[i] for i in found.tolist()}


def phrases(rows: list[tuple[object, str | None]], window: int) -> Phrases:
    texts = [(t or "").encode() for _, t in rows]
    held: dict[int, dict[tuple[int, ...], set[int]]] = {}
    seen: list[tuple[str, np.ndarray]] = []
    for block in K.blocks(texts):
        w = K.words(block, K.ALNUM, K.FOLDED)
        seen += [("null" if rows[block.first + i][0] is None else str(rows[block.first + i][0]), w.hash[w.bounds[i] : w.bounds[i + 1]]) for i in range(len(block))]
    vocabulary = np.unique(np.concatenate([h for _, h in seen])) if seen else np.empty(0, np.uint64)
    names = sorted({x for x, _ in seen})
    number = {x: i for i, x in enumerate(names)}
    for item, h in seen:
        ids = (np.searchsorted(vocabulary, h) + 2).tolist()
        for i in range(max(1, len(ids) - window + 1) if ids else 0):
            held.setdefault(len(ids[i : i + window]), {}).setdefault(tuple(ids[i : i + window]), set()).add(number[item])
    lists, by_length = [], {}
    for length, found in held.items():
        by_length[length] = (np.array(list(found), np.int32).reshape(-1, length), np.arange(len(lists), len(lists) + len(found), dtype=np.int32))
        lists += [sorted(x) for x in found.values()]
    bounds = np.cumsum([0, *map(len, lists)])
    return Phrases(vocabulary, by_length, names, np.fromiter((x for y in lists for x in y), np.int32, int(bounds[-1])), bounds)


def _hits(parts: list[tuple[int, np.ndarray, np.ndarray]], p: Phrases):
    """(window, document, first word, length) of every occurrence in one shard."""
    text = np.concatenate([np.append(x, 1) for _, x, _ in parts])
    text[-1] = 0
    where = np.concatenate([np.append(at, -1) for _, _, at in parts])
    doc = np.concatenate([np.full(len(x) + 1, d) for d, x, _ in parts])
    index = FMIndex(text, len(p.vocabulary) + 2)
    for length, (windows, number) in p.by_length.items():
        low, high = index.search(windows.astype(np.int64))
        n = high - low
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        at = index.locate(rows)
        yield np.repeat(number, n), doc[at], where[at], length


class Shard:
    """Texts of a task that wait for their index: words of each, and stretches of known words."""

    def __init__(self, p: Phrases):
        self.p, self.door = p, np.zeros(1 << 16, bool)
        # A small table says for most words at once that the benchmark lacks them.
        self.door[(p.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.clear()

    def clear(self) -> None:
        self.counts, self.parts, self.found, self.size = [], [], {}, 0

    def _search(self) -> None:
        if self.parts:
            for number, doc, at, length in _hits(self.parts, self.p):
                order = np.argsort(doc, kind="stable")
                docs, cut = np.unique(doc[order], return_index=True)
                for d, a, n in zip(docs.tolist(), np.split(at[order], cut[1:]) if len(docs) else [], np.split(number[order], cut[1:]) if len(docs) else [], strict=True):
                    self.found.setdefault(d, []).append((a, length, n))
        self.parts, self.size = [], 0

    def add(self, texts: list[bytes]) -> None:
        p, base = self.p, sum(map(len, self.counts))
        for block in K.blocks(texts):
            w = K.words(block, K.ALNUM, K.FOLDED)
            self.counts.append(w.counts)
            if not p.by_length:
                continue
            some = np.flatnonzero(self.door[(w.hash & np.uint64(0xFFFF)).astype(np.int64)])
            slot = np.searchsorted(p.vocabulary, w.hash[some])
            same = p.vocabulary[np.minimum(slot, len(p.vocabulary) - 1)] == w.hash[some]
            symbol = np.ones(len(w.hash), np.int64)
            symbol[some[same]] = slot[same] + 2
            border = np.zeros(len(w.hash) + 1, bool)
            border[w.bounds] = True
            stop = np.flatnonzero((symbol == 1) | border[:-1])
            edges = np.unique(np.concatenate([stop, stop[symbol[stop] == 1] + 1, [0, len(symbol)]]))
            begin, end = edges[:-1], edges[1:]
            keep = (end - begin >= p.shortest) & (symbol[np.minimum(begin, max(0, len(symbol) - 1))] > 1) if len(symbol) else np.zeros(0, bool)
            for b, e in zip(begin[keep].tolist(), end[keep].tolist(), strict=True):
                d = int(w.doc[b])
                self.parts.append((base + block.first + d, symbol[b:e], np.arange(b, e) - w.bounds[d]))
                self.size += e - b + 1
                if self.size >= SHARD:
                    self._search()

    def finish(self) -> tuple[np.ndarray, dict]:
        """Words of each text, and its occurrences: {text number: [(first word, length, window) arrays]}; then it is empty."""
        self._search()
        out = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64), self.found
        self.clear()
        return out


def _passes(benchmark: DataFrame, window: int, pass_bytes: int):
    """The benchmark's phrases, in parts whose size is checked before they are sent to the tasks."""
    rows = benchmark.select(F.col("item_id"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    n = max(1, -(-size // pass_bytes))
    for i in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
        found = phrases([tuple(r) for r in part.collect()], window)
        if found.by_length or n == 1:
            yield found


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` with three more columns: _n_words, _spans (begin and end words of merged removal spans, as
    pairs in a flat list) and _items (sorted ids of the items found)."""
    modest_batches(docs.sparkSession)
    names = [free_name(docs.columns, x) for x in ("_n_words", "_spans", "_items")]
    at = docs.columns.index("text")
    out = docs.withColumns({names[0]: F.lit(0).cast("long"), names[1]: F.array().cast("array<long>"), names[2]: F.array().cast("array<string>")})
    for p in _passes(benchmark, window, pass_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(p)

        def run(batches, sent=sent):
            shard, waiting, held = Shard(sent.value), [], 0

            def done():
                counts, found = shard.finish()
                base = 0
                for b in waiting:
                    n = counts[base : base + b.num_rows]
                    spans, items = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
                    for d in range(b.num_rows):
                        hits = found.get(base + d)
                        if not hits:
                            continue
                        mask = np.zeros(n[d], bool)
                        for first, length, _ in hits:
                            mask |= K.spans_cover(first, length, n[d])
                        for i in range(0, len(spans[d]), 2):
                            mask[spans[d][i] : spans[d][i + 1]] = True
                        spans[d] = np.stack(K.runs_of(mask), axis=1).ravel().tolist()
                        items[d] = sorted(sent.value.items(np.concatenate([w for _, _, w in hits])) | set(items[d]))
                    base += b.num_rows
                    yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], b.schema.names)

            for b in batches:
                texts = K.encoded(b.column(at))
                shard.add(texts)
                waiting.append(b)
                held += sum(map(len, texts))
                if held >= HELD:
                    yield from done()
                    waiting, held = [], 0
            yield from done()

        out = out.mapInArrow(K.tidy(run), out.schema)
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``."""
    found = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window)
    hit = F.aggregate("_spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")), lambda a, x: F.struct((a["n"] + a["sign"] * x).alias("n"), (-a["sign"]).alias("sign")))["n"]
    return found.select("doc_id", F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` with the removal spans cut out of the texts, white space around a cut as it was before it.
    A document of which no word is left goes; n_chars, where there is one, follows a cut text."""
    found = find(docs, benchmark, window)
    spans, at = found.columns[-2], docs.columns.index("text")
    chars = next((i for i, x in enumerate(docs.columns) if x == "n_chars"), None)

    def run(batches):
        for b in batches:
            texts, cut = b.column(at).to_pylist(), b.column(b.num_columns - 2).to_pylist()
            n, total = (b.column(chars).to_pylist() if chars is not None else None), b.column(b.num_columns - 3).to_pylist()
            keep = np.ones(len(texts), bool)
            for i in (i for i, x in enumerate(cut) if x):
                raw = texts[i].encode()
                where = [m.span() for m in _WORD.finditer(raw.translate(_LOWER))]
                left, from_ = [], 0
                for s, e in zip(cut[i][0::2], cut[i][1::2], strict=True):
                    left.append(raw[from_ : where[s][0]])
                    from_ = where[e - 1][1]
                texts[i] = b"".join([*left, raw[from_:]]).decode()
                keep[i] = sum(cut[i][1::2]) - sum(cut[i][0::2]) < total[i]
                if n is not None and n[i] is not None:
                    n[i] = len(texts[i])
            columns = list(b.columns[:-3])
            columns[at] = pa.array(texts, b.schema.field(at).type)
            if n is not None:
                columns[chars] = pa.array(n, b.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-3]).filter(pa.array(keep))

    return found.mapInArrow(K.tidy(run), docs.schema)

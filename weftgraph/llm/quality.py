"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of it. Bytes get learned vectors, learned
filters run over them, each filter's largest answer in a chunk is kept, and the mean and the maximum of
these over the document's chunks give one probability.

The network is fitted on the driver on a bounded sample: about ``per_class`` labelled documents of each class,
chosen by a hash of doc_id, of each at most ``chunks_per_doc`` chunks spread over the text.
Scoring reads every byte of every text. The class shares of all labels set the prior.

Defined results: null or empty text is scored as one chunk of padding; labels that are null are not
used, and of repeated labels the lowest counts; without labels of both classes every score is the prior (1 without
any label); rows that repeat an id are scored each; of a very long text 64 chunks at a time are laid out; an empty table gives an empty table; other columns are kept by
``keep`` and not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K
from weftgraph.llm.storage import free_name, modest_batches

CHUNK, OVERLAP, DIMS, WIDTH, STRIDE, FILTERS = 512, 16, 8, 12, 4, 40
PER_CLASS, CHUNKS_PER_DOC, STEPS, BATCH, RATE, CUT = 2000, 6, 700, 48, 0.004, 0.3
PLACES = (CHUNK - WIDTH) // STRIDE + 1


@dataclass
class Network:
    vectors: np.ndarray  # 256 x DIMS
    filters: np.ndarray  # WIDTH * DIMS x FILTERS
    bias: np.ndarray
    head: np.ndarray  # 2 * FILTERS
    offset: np.ndarray  # 1

    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.bias, self.head, self.offset]


def fresh(seed: int = 11) -> Network:
    r = np.random.default_rng(seed)
    f = lambda *s: r.normal(0, 1, s).astype(np.float32)
    return Network(f(256, DIMS) * 0.5, f(WIDTH * DIMS, FILTERS) * 0.2, np.zeros(FILTERS, np.float32), f(2 * FILTERS) * 0.05, np.zeros(1, np.float32))


def chunk_starts(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the documents' chunks begin and their documents end, and the number of each document's first chunk."""
    step = CHUNK - OVERLAP
    n = np.maximum(1, -(-(end - begin - OVERLAP) // step))
    first = np.cumsum(n) - n
    return np.repeat(begin - first * step, n) + np.arange(n.sum()) * step, np.repeat(end, n), first


def cut_chunks(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The chunks that begin ``at``; zero bytes stand past the end of a document."""
    where = at[:, None] + np.arange(CHUNK)
    return np.where(where < end[:, None], data[np.minimum(where, len(data) - 1)], 0).astype(np.uint8)


def _windows(net: Network, chunks: np.ndarray) -> np.ndarray:
    """Chunks x PLACES x (WIDTH * DIMS), a view on the bytes' vectors."""
    v = net.vectors[chunks].reshape(len(chunks), CHUNK * DIMS)
    return as_strided(v, (len(chunks), PLACES, WIDTH * DIMS), (v.strides[0], STRIDE * DIMS * v.itemsize, v.itemsize))


def pooled(net: Network, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest answer in each chunk, and where."""
    answer = (np.ascontiguousarray(_windows(net, chunks)).reshape(-1, WIDTH * DIMS) @ net.filters).reshape(len(chunks), PLACES, FILTERS)
    at = answer.argmax(axis=1)
    return np.maximum(np.take_along_axis(answer, at[:, None], 1)[:, 0] + net.bias, 0), at


def logits(net: Network, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    at, stop, first = chunk_starts(begin, end)
    parts = (cut_chunks(data, at[i : i + 64], stop[i : i + 64]) for i in range(0, len(at), 64))
    top = np.concatenate([(np.ascontiguousarray(_windows(net, x)).reshape(-1, WIDTH * DIMS) @ net.filters).reshape(-1, PLACES, FILTERS).max(axis=1) for x in parts])
    top = np.maximum(top + net.bias, 0)
    mean = np.add.reduceat(top, first, axis=0) / np.diff(np.append(first, len(at)))[:, None]
    return np.hstack([mean, np.maximum.reduceat(top, first, axis=0)]) @ net.head + net.offset


def _gradients(net: Network, chunks: np.ndarray, owner: np.ndarray, docs: int, label: np.ndarray) -> list[np.ndarray]:
    top, at = pooled(net, chunks)
    first = np.searchsorted(owner, np.arange(docs))
    n = np.diff(np.append(first, len(owner)))
    most = np.maximum.reduceat(top, first, axis=0)
    features = np.hstack([np.add.reduceat(top, first, axis=0) / n[:, None], most])
    error = (1 / (1 + np.exp(-(features @ net.head + net.offset))) - label) / docs
    g_features = error[:, None] * net.head
    winner = (top == most[owner]).astype(np.float32)
    winner /= np.add.reduceat(winner, first, axis=0)[owner]
    g_top = (g_features[owner, :FILTERS] / n[owner, None] + g_features[owner, FILTERS:] * winner) * (top > 0)
    c, f = np.nonzero(g_top)
    g = g_top[c, f]
    place = at[c, f][:, None] * STRIDE + np.arange(WIDTH)
    symbol = chunks[c[:, None], place]
    seen = net.vectors[symbol].reshape(len(c), WIDTH * DIMS) * g[:, None]
    g_filters = np.stack([np.bincount(f, seen[:, k], FILTERS) for k in range(WIDTH * DIMS)]).astype(np.float32)
    back = (net.filters.T[f] * g[:, None]).reshape(-1, DIMS)
    g_vectors = np.stack([np.bincount(symbol.ravel(), back[:, k], 256) for k in range(DIMS)], axis=1).astype(np.float32)
    return [g_vectors, g_filters, g_top.sum(axis=0), features.T @ error + 1e-4 * net.head, error.sum(keepdims=True)]


def train(samples: list[tuple[bytes, int]], steps: int = STEPS) -> Network:
    """``samples``: chunks of a document one after the other, and its label. Every step sees as many of either class."""
    net, r = fresh(), np.random.default_rng(5)
    parts = net.parts()
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    label = np.array([y for _, y in samples], np.float32)
    rows = [np.frombuffer(x, np.uint8).reshape(-1, CHUNK) for x, _ in samples]
    sides = [np.flatnonzero(label == y) for y in (0, 1)]
    for t in range(1, steps + 1):
        pick = np.concatenate([r.choice(x, BATCH // 2, replace=len(x) < BATCH // 2) for x in sides])
        owner = np.repeat(np.arange(len(pick)), [len(rows[k]) for k in pick])
        rate = RATE * (1 - (t - 1) / steps) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        for p, g, a, b in zip(parts, _gradients(net, np.concatenate([rows[k] for k in pick]), owner, len(pick), label[pick]), m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= (rate * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id: F.Column) -> F.Column:
    """Documents no label of which is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _take_chunks(limit: int):
    def run(batches):
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), K.encoded(b.column(1)), strict=True):
                data = np.frombuffer(text + b" ", np.uint8)
                at, stop, _ = chunk_starts(np.array([0]), np.array([len(text)]))
                if len(at) > limit:
                    at = at[np.sort(np.random.default_rng(zlib.crc32(str(doc).encode())).choice(len(at), limit, replace=False))]
                out.append(cut_chunks(data, at, stop[: len(at)]).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(2)], ["doc_id", "chunks", "quality"])

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, chunks_per_doc: int = CHUNKS_PER_DOC) -> tuple[Network | None, float]:
    """The network, and the logit to add for the true class shares; None where a class is missing."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(0, 0), sizes.get(1, 0)
    prior = float(np.log((good + 1) / (bad + 1))) if bad + good else 50.0
    if not bad or not good:
        return None, prior
    share = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    picked = known.filter(share < F.when(F.col("quality") == 0, min(1.0, per_class / bad)).otherwise(min(1.0, per_class / good)))
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))  # no other column, whatever its name
    rows = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select(F.col("doc_id").cast("long"), "text", F.col("quality").cast("int"))
    found = rows.mapInArrow(K.tidy(_take_chunks(chunks_per_doc)), "doc_id long, chunks binary, quality int").collect()
    samples = [(bytes(x["chunks"]), x["quality"]) for x in sorted(found, key=lambda x: (x["doc_id"], bytes(x["chunks"])))]
    n1 = sum(y for _, y in samples)
    if not samples or n1 in (0, len(samples)):
        return None, prior
    return train(samples), prior


def _scores(texts: list[bytes], net: Network | None, shift: float) -> np.ndarray:
    x = np.zeros(len(texts))
    if net is not None:
        for block in K.blocks(texts):
            x[block.first : block.first + len(block)] = logits(net, block.data, block.begin, block.end)
    return 1 / (1 + np.exp(-np.clip(x + shift, -60, 60)))


def score(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``docs`` with a column _score more."""
    modest_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))
    name = free_name(docs.columns, "_score")
    at = docs.columns.index("text")

    def run(batches):
        net, shift = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_scores(K.encoded(b.column(at)), net, shift), pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(K.tidy(run), docs.withColumn(name, F.lit(0.0).cast("double")).schema)


def report(docs: DataFrame, labels: DataFrame, cut: float = CUT, **how) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    rows = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, **how)
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= cut).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, cut: float = CUT, **how) -> DataFrame:
    """The rows of ``docs`` that score at least ``cut``."""
    rows = score(docs, labels, **how)
    return rows.filter(F.col(rows.columns[-1]) >= cut).select(*docs.columns)

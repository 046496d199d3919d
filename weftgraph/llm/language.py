"""Language identification: multinomial naive Bayes over hashed character n-grams.

Each text's n-grams of ``ORDERS`` characters (code points; A-Z in lower case) fall into ``BUCKETS`` buckets. Counts for
each language are made by the tasks over labelled documents and summed; the matrix of log probabilities is broadcast
(its size is languages x buckets, whatever the corpus) with the languages' log shares among all labelled documents, and
a batch is scored by one sparse product.

The labelled documents used are a bounded sample: about ``per_lang`` of each language, chosen
by a hash of doc_id. Texts are read whole.

Defined results: ``und`` with score 0 for null text or text without a letter; ties go to the language first in the
alphabet; rows that repeat an id are scored each; a very long text is a block of its own, whose n-grams are counted
together; a table without labelled rows gives ``und`` throughout;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K
from weftgraph.llm.storage import modest_batches

ORDERS, BUCKETS, PER_LANG, SMOOTHING, UNKNOWN = (1, 2, 3, 4), 1 << 15, 4000, 0.5, "und"
_U = np.uint64


def characters(block: K.Block) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character of a block (its UTF-8 bytes; A-Z as a-z, white space as the blank), and its document."""
    data = block.data
    low = np.arange(256, dtype=np.uint32)
    low[0x41:0x5B] += 0x20
    low[list(K.SPACES)] = 0x20
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(lead, len(data)))
    out = low[data[lead]]
    for i in range(1, 4):
        more = np.flatnonzero(size > i)
        out[more] = out[more] << np.uint32(8) | data[lead[more] + i]
    owner = np.searchsorted(block.end, lead)  # a document's closing space is its own
    return out, owner


def grams(block: K.Block) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram; a space is put before a text and after it, white space counts as one kind of space."""
    chars, owner = characters(block)
    first = np.searchsorted(owner, np.arange(len(block)))
    v = K.mix(np.insert(chars, first, 0x20).astype(_U) + _U(0x51ED27))
    own = np.insert(owner, first, np.arange(len(block)))
    docs, buckets = [], []
    for n in ORDERS:
        h = v[: max(0, len(v) - n + 1)].copy()
        for i in range(1, n):
            h *= K.BASE
            h += v[i : i + len(h)]
        inside = own[: len(h)] == own[n - 1 : n - 1 + len(h)]
        buckets.append((K.mix(h + _U(n)) >> _U(64 - 15)).astype(np.int32)[inside])
        docs.append(own[: len(h)][inside])
    return np.concatenate(docs), np.concatenate(buckets)


def counts_by_document(block: K.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts: document, bucket, count."""
    doc, bucket = grams(block)
    key, n = np.unique(doc.astype(np.int64) * BUCKETS + bucket, return_counts=True)
    return key // BUCKETS, key % BUCKETS, n


def held_out(doc_id: F.Column) -> F.Column:
    """Documents no label of which is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _count(langs: list[str]):
    def run(batches):
        total = np.zeros(len(langs) * BUCKETS, np.int64)
        number = {x: i for i, x in enumerate(langs)}
        for b in batches:
            lang = np.array([number[x] for x in b.column(1).to_pylist()], np.int64)
            for block in K.blocks(K.encoded(b.column(0)), K.BLOCK):
                doc, bucket = grams(block)
                total += np.bincount(lang[block.first + doc] * BUCKETS + bucket, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

    return run


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, the matrix languages x buckets of log probabilities, and the log prior (shares of all labelled documents)."""
    known = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.coalesce(F.col("doc_id"), F.lit(0))))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, BUCKETS), np.float32), np.zeros(0)
    rate = F.coalesce(*(F.when(F.col("lang") == x, F.lit(min(1.0, per_lang / sizes[x]))) for x in langs))
    share = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    parts = known.filter(share < rate).select("text", "lang").mapInArrow(K.tidy(_count(langs)), "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    table = np.zeros(len(langs) * BUCKETS, np.float64)
    for r in parts.toArrow().to_batches():
        table[r.column(0).to_numpy()] = r.column(1).to_numpy()
    table = table.reshape(len(langs), BUCKETS) + SMOOTHING
    prior = np.log([sizes[x] / sum(sizes.values()) for x in langs])
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32), prior


def score_texts(texts: list[bytes], weights: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the best language's number, and its probability by the evidence of at most 256 mean n-grams."""
    best, sure = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    by_bucket = np.ascontiguousarray(weights.T)
    for block in K.blocks(texts, K.BLOCK // 2):
        doc, bucket, n = counts_by_document(block)
        product = by_bucket[bucket] * n[:, None]
        bounds = np.searchsorted(doc, np.arange(len(block)))
        sums = np.add.reduceat(np.vstack([product, np.zeros((1, product.shape[1]), product.dtype)]).astype(np.float64), bounds, axis=0)
        total = np.add.reduceat(np.append(n, 0), bounds)
        mean = sums / np.maximum(total, 1)[:, None] * np.minimum(total, 256)[:, None] + prior
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        at = slice(block.first, block.first + len(block))
        best[at] = (sums + prior).argmax(axis=1)
        sure[at] = p[np.arange(len(block)), best[at]] / p.sum(axis=1)
    return best, sure


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, text, lang)."""
    modest_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, per_lang))

    def run(batches):
        names, w, prior = sent.value
        for b in batches:
            spoken = np.array(b.column(2).to_numpy(zero_copy_only=False), bool)
            n = b.num_rows
            if names:
                best, sure = score_texts(K.encoded(b.column(3)), w, prior)
                lang = [names[i] if s else UNKNOWN for i, s in zip(best.tolist(), spoken, strict=True)]
                sure = np.where(spoken, sure, 0.0)
            else:
                lang, sure = [UNKNOWN] * n, np.zeros(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("spoken"), text.alias("text"))
    return rows.mapInArrow(K.tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")

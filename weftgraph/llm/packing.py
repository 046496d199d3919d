"""Cost-balanced packing of token sequences.

Every document becomes its token ids and one end id. Whole sequences are cut off long documents
at once; what is left of each is gathered per task, up to ``hold`` ids. For these rests just as
many sequences are opened as their ids fill: full ones, and one each of the powers of two in the
remainder, which need no padding. Rests are dealt longest first, each to the sequence of lowest
estimated cost (``linear`` x length + ``quadratic`` x length squared, since attention stays within a
piece) that has room; a piece longer than the room is cut, and its rest is dealt on.

Nothing shuffles: a task packs what it reads, in the order it reads it, so a repeated task gives
the same rows. Sequence ids hold the partition's number in their upper half.

Defined results: an added token of the file that stands in a text is one id, as in the library; null or empty text is one piece of just the end id; rows that repeat an id are
documents of their own; very long texts are cut; an empty table packs into no sequences; columns
beside doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K

from weftgraph.llm.storage import modest_batches
from weftgraph.llm.tokens import tokenizer

CAPACITY, END, HOLD, CHARS = 2048, 1, 1 << 22, 1 << 18
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Out:
    """Columns of finished pieces."""

    def __init__(self, first: int, with_ids: bool):
        self.next, self.with_ids, self.rows = first, with_ids, []

    def add(self, doc, start: int, ids: np.ndarray, total: int, sequence: int, offset: int) -> None:
        raw = ids.astype("<u4", copy=False).tobytes()
        self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, sequence, offset, ids if self.with_ids else None))

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * 8
        self.rows = []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
        if self.with_ids:
            arrays.append(pa.array([x.astype(np.int64) for x in columns[7]], pa.list_(pa.int64())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)


def deal(rests: list[tuple], out: _Out, capacity: int, linear: float, quadratic: float) -> None:
    """Pack (doc, start, ids, total) pieces shorter than ``capacity`` into sequences that end up full."""
    size = sum(len(x[2]) for x in rests)
    rooms = [capacity] * (size // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if (size % capacity) >> b & 1]
    heap = [(0.0, i) for i in range(len(rooms))]  # a heap already
    first, filled = out.next, [0] * len(rooms)
    out.next += len(rooms)
    waiting = [(-len(x[2]), i, x) for i, x in enumerate(rests)]
    waiting.sort(key=lambda x: x[:2])
    for _, _, (doc, start, ids, total) in waiting:
        while len(ids):
            cost, i = heap[0]
            take = min(len(ids), rooms[i] - filled[i])
            out.add(doc, start, ids[:take], total, first + i, filled[i])
            filled[i] += take
            if filled[i] == rooms[i]:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (cost + linear * take + quadratic * take * take, i))
            start, ids = start + take, ids[take:]


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END, path: str | None = None, linear: float = 1.0, quadratic: float = 1 / 2048, hold: int = HOLD, with_ids: bool = False) -> DataFrame:
    """One row for each piece; ``with_ids`` adds the piece's ids. ``path``: a `tokenizers` file on every executor."""

    def run(batches):
        out, rests, held = _Out(TaskContext.get().partitionId() << 32, with_ids), [], 0
        for b in batches:
            docs_, texts = b.column(0).to_pylist(), [x or "" for x in b.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= CHARS):
                    chars += len(texts[to])
                    to += 1
                ids, sizes = tokenizer(path).encode(texts[at:to], added=True)
                pieces = np.split(ids, np.cumsum(sizes)[:-1])
                for doc, x in zip(docs_[at:to], pieces, strict=True):
                    x = np.append(x, np.uint32(end_id))
                    whole = len(x) // capacity * capacity
                    for s in range(0, whole, capacity):
                        out.add(doc, s, x[s : s + capacity], len(x), out.next, 0)
                        out.next += 1
                    if whole < len(x):
                        rests.append((doc, whole, x[whole:].copy(), len(x)))
                        held += len(x) - whole
                at = to
                if held >= hold:
                    deal(rests, out, capacity, linear, quadratic)
                    rests, held = [], 0
                if len(out.rows) >= 10_000:
                    yield out.batch()
        deal(rests, out, capacity, linear, quadratic)
        yield out.batch()

    modest_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(K.tidy(run), _SCHEMA + (", ids array<long>" if with_ids else ""))

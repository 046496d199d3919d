"""Numpy kernels over the bytes of many documents at once: words, rolling hashes, minimizers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one call of a kernel works on; a longer document is a block of its own.
BLOCK = 1 << 18
#: Bytes whose words are hashed at a time.
PART = 1 << 14
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def _codes() -> np.ndarray:
    return np.random.default_rng(7919).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


#: A random odd number for each byte; FOLDED gives A-Z those of a-z.
CODES = _codes()
FOLDED = CODES.copy()
FOLDED[0x41:0x5B] = CODES[0x61:0x7B]
#: True for the bytes of words `[^\x20\x09-\x0D]+`.
SOLID = np.ones(256, bool)
SOLID[list(SPACES)] = False
#: True for the bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

BASE = U64(0x9E3779B97F4A7C15)
_STEP = U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (in place)."""
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xA0761D6478BD642F)
    x ^= x >> U64(29)
    return x


def _power_table(base: U64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i below n."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        inverse = U64(pow(int(BASE), -1, 1 << 64))
        if size > 2 * BLOCK:
            return _power_table(BASE, size), _power_table(inverse, size)
        _POWERS[size] = _power_table(BASE, size), _power_table(inverse, size)
    return _POWERS[size]


def tidy(run):
    """``run`` over a task's batches, after which freed memory goes back to the machine: workers wait for their next task."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task


@dataclass
class Block:
    """Some documents' bytes in one array, with a space after each; ``first`` is the row of the first of them."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.begin)


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def blocks(texts: list[bytes], limit: int = BLOCK) -> Iterator[Block]:
    """Cut a batch into runs of whole documents of about ``limit`` bytes, so memory follows the longest document alone."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= limit):
            size += len(texts[to]) + 1
            to += 1
        lengths = np.fromiter(map(len, texts[at:to]), np.int64, to - at)
        end = np.cumsum(lengths + 1) - 1
        yield Block(np.frombuffer(b" ".join(texts[at:to]) + b" ", np.uint8), end - lengths, end, at)
        at = to


@dataclass
class Words:
    """Where the words of a block begin and end (bytes), whose they are, and a 64-bit hash of each."""

    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    #: First word of each document, and one more entry for the end.
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def weights(n: int) -> np.ndarray:
    """A random multiplier for each of the first n places of a word."""
    return _TABLE[:n] if n <= len(_TABLE) else mix(np.arange(1, n + 1, dtype=U64) * _STEP)


_TABLE = mix(np.arange(1, 4097, dtype=U64) * _STEP)


def piece_hashes(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece of ``values`` (random words, one a symbol), pieces starting at ``begin``.

    Each symbol is multiplied by a random number of its place, and the products are summed (multilinear hashing):
    unlike powers of a base, these places have no structure that equal sums could follow from. Works in parts, so
    that memory doesn't follow the length of a piece.
    """
    out, size = np.zeros(len(begin), U64), len(values)
    edges = np.append(begin, size)
    for low in range(0, size, 2 * BLOCK):
        high = min(low + 2 * BLOCK, size)
        i, j = int(np.searchsorted(begin, low, "right")) - 1, int(np.searchsorted(begin, high))
        starts = np.maximum(edges[i:j], low)
        length = np.minimum(edges[i + 1 : j + 1], high) - starts
        place = np.arange(low, high) - np.repeat(edges[i:j], length)
        most = int(place.max()) + 1
        by = _TABLE[place] if most <= len(_TABLE) else mix((place + 1).astype(U64) * _STEP)
        out[i:j] += np.add.reduceat(values[low:high] * by, starts - low)
    return mix(out)


def words(block: Block, solid: np.ndarray, codes: np.ndarray | None = None) -> Words:
    """Words are runs of ``solid`` bytes; equal words under ``codes`` get equal hashes, without codes none are made."""
    mask = solid[block.data]
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if len(mask) and mask[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    bounds = np.searchsorted(begin, np.append(block.begin, len(block.data) + 1))
    hashes, n = np.empty(len(begin), U64), 0 if codes is None else len(begin)
    at = 0
    while at < n:  # a part at a time: codes take eight bytes for each byte, and are fastest in the processor's cache
        to = max(at + 1, int(np.searchsorted(end, begin[at] + PART)))
        low, high = int(begin[at]), int(end[to - 1])
        first = np.cumsum(end[at:to] - begin[at:to]) - (end[at:to] - begin[at:to])
        hashes[at:to] = piece_hashes(codes.take(block.data[low:high][mask[low:high]]), first)
        at = to
    return Words(begin, end, np.repeat(np.arange(len(block), dtype=np.int32), np.diff(bounds)), hashes, bounds)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive entries (document borders are the caller's)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    by = weights(k)
    out = hashes[:n] * by[0]
    for i in range(1, k):
        out += hashes[i : n + i] * by[i]
    return mix(out)


def spans_cover(begin: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """True at the positions below n that some span [begin, begin + length) covers."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + length, -1)
    return np.cumsum(change[:n]) > 0


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[0::2], edge[1::2]

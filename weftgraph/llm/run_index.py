"""A run-length compressed suffix index over many short texts, and matching statistics against it."""

from __future__ import annotations

import numpy as np

def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys below 2**bits, equal ones by position, and each key's rank from 1 on."""
    n = len(key)
    room = max(1, n - 1).bit_length()
    if bits + room < 64:  # key and position in one word: sorting values is faster than sorting positions
        both = np.sort(key.astype(np.uint64) << np.uint64(room) | np.arange(n, dtype=np.uint64))
        order = (both & np.uint64((1 << room) - 1)).astype(np.int64)
        now = both >> np.uint64(room)
    else:
        order = np.argsort(key, kind="stable")
        now = key[order]
    rank = np.empty(n, np.uint64)
    rank[order] = np.cumsum(np.concatenate([[True], now[1:] != now[:-1]]), dtype=np.uint64)
    return order, rank


def sorted_suffixes(text: np.ndarray, left: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by prefix doubling, each suffix ending with its own text (``left``: symbols to there), equal ones in
    the order of their texts; and for each row of it but the first, whether its first ``width`` symbols equal those of the row before."""
    n = len(text)
    dense = np.zeros(257, np.uint64)
    held = np.unique(text)
    dense[held] = np.arange(len(held))
    bits, near = max(1, len(held) - 1).bit_length(), None
    depth = max(4, min(7, (63 - max(1, n - 1).bit_length()) // bits))  # what one word holds beside the position
    key, symbols = np.zeros(n, np.uint64), dense[text]
    for i in range(depth):
        symbol = np.zeros(n, np.uint64)
        symbol[: n - i] = symbols[i:]
        symbol[left <= i] = 0
        key = key << np.uint64(bits) | symbol
    order, rank = _sorted(key, bits * depth)
    room = n.bit_length()
    while True:
        if depth <= width:
            near = (rank, width - depth)  # two overlapping stretches of this depth make the width
        if depth >= most:
            break
        after = np.zeros(n, np.uint64)
        after[: max(0, n - depth)] = rank[depth:]
        after[left <= depth] = 0
        order, rank = _sorted(rank << np.uint64(room) | after, 2 * room)
        depth *= 2
    one, two = near[0][order], near[0][np.minimum(order + near[1], n - 1)]
    whole = left[order] >= width
    return order, whole[1:] & whole[:-1] & (one[1:] == one[:-1]) & (two[1:] == two[:-1])


class RunIndex:
    """The Burrows-Wheeler transform of ``texts`` in runs, with the text positions of each run's first and last row.

    ``value`` gives each text a number; for every string of ``width`` symbols the index knows the least
    value of the texts that hold it, one entry for each such string that two rows or more begin with.
    """

    def __init__(self, texts: list[bytes], value: np.ndarray, width: int):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        self.text = raw.astype(np.int16) + np.int16(1)
        end = np.cumsum(sizes + 1) - 1
        self.text[end] = 0
        n = self.n = len(self.text)
        self.begin, self.size, self.width = end - sizes, sizes, width
        left = np.repeat(end, sizes + 1) - np.arange(n)
        order, same = sorted_suffixes(self.text, left, width, max(width, int(sizes.max(initial=0))))
        last = self.text[order - 1]
        first = np.flatnonzero(np.append(True, last[1:] != last[:-1]))
        self.run, self.symbol = first, last[first]
        self.length = np.diff(np.append(first, n))
        self.sample_first, self.sample_last = order[first], order[first + self.length - 1]
        # Runs by symbol, for ranks and for the nearest run of a symbol.
        by = np.lexsort((first, self.symbol))
        self.by, self.keys = by, self.symbol[by].astype(np.int64) * (n + 1) + first[by]
        before = np.cumsum(self.length[by]) - self.length[by]
        self.group = np.searchsorted(self.symbol[by], np.arange(258))
        counts = np.bincount(self.text, minlength=257)
        start = np.cumsum(counts) - counts
        base = np.append(before, n)[self.group]
        #: The row that the first row of each run leads to when its symbol is put before.
        self.target = np.empty(len(first), np.int64)
        self.target[by] = start[self.symbol[by]] + before - base[self.symbol[by]]
        # Groups of rows with equal beginnings of full width, and the least value in each.
        owner = np.repeat(np.arange(len(texts)), sizes + 1)
        self.bounds = np.flatnonzero(np.append(True, ~same))
        self.least = np.minimum.reduceat(value[owner[order]], self.bounds)

    def _at(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Of the runs of each symbol, in order, how many begin before the row (counted over all symbols)."""
        return np.searchsorted(self.keys, symbol.astype(np.int64) * (self.n + 1) + row)

    def common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols the texts have in common from positions i and j on, up to ``most``."""
        out, live = np.zeros(len(i), np.int64), np.flatnonzero(most > 0)
        while len(live):
            at = out[live]
            # Eight symbols at a time: the first that differ, or end a text, tell how far.
            a, b = i[live, None] + at[:, None] + np.arange(8), j[live, None] + at[:, None] + np.arange(8)
            a, b = self.text[np.minimum(a, self.n - 1)], self.text[np.minimum(b, self.n - 1)]
            stop = (a != b) | (a == 0)
            more = np.where(stop.any(axis=1), stop.argmax(axis=1), 8)
            out[live] = np.minimum(at + more, most[live])
            live = live[(more == 8) & (out[live] < most[live])]
        return out

    def least_values(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stream the texts numbered ``patterns``, all of them in the index, from their ends: at each place the longest match in the index and a row
        that begins with it; where it has ``width`` symbols, the least value of the texts that hold these, else none (max).
        All windows' values, one text after the other, and where each text's begin."""
        size = self.size[patterns]
        windows = np.maximum(0, size - self.width + 1)
        first = np.cumsum(windows) - windows
        out = np.full(int(windows.sum()), np.iinfo(np.int64).max)
        order = np.argsort(-size, kind="stable")  # longest first: those still live are a prefix
        patterns, size, first = patterns[order], size[order], first[order]
        row, at, matched = (np.zeros(len(patterns), np.int64) for _ in range(3))
        place = self.begin[patterns] + size
        lives = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")
        for t, live in enumerate(lives.tolist()):
            place[:live] -= 1
            c, q = self.text[place[:live]], row[:live].copy()
            run = np.searchsorted(self.run, q, "right") - 1
            miss = np.flatnonzero((self.symbol[run] != c) | (matched[:live] == 0))
            if len(miss):
                cm, want = c[miss], matched[miss]
                after = self._at(cm, q[miss])
                up, down = self.by[np.maximum(after - 1, self.group[cm])], self.by[np.minimum(after, self.group[cm + 1] - 1)]
                one, two = self.sample_last[up], self.sample_first[down]
                here = place[miss] + 1
                a, b = self.common(here, one, want), self.common(here, two, want)
                left = a > b
                run[miss] = np.where(left, up, down)
                q[miss] = np.where(left, self.run[up] + self.length[up] - 1, self.run[down])
                at[miss] = np.where(left, one, two)
                matched[miss] = np.maximum(a, b)
            row[:live] = self.target[run] + q - self.run[run]
            at[:live] -= 1
            matched[:live] += 1
            if t + 1 >= self.width:
                full = np.flatnonzero(matched[:live] >= self.width)
                out[first[full] + size[full] - 1 - t] = self.least[np.searchsorted(self.bounds, row[full], "right") - 1]
        start = np.empty(len(order), np.int64)
        start[order] = first
        return out, start

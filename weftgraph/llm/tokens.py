"""Byte-pair token ids of many texts at once.

Pre-tokens (the pieces within which byte pairs merge) are cut by numpy rules over code points
and hashed; each different one is merged once and then looked up. The ids equal those of the
`tokenizers` library for the same file: at its default setting with ``added``, where the file's added tokens are
cut out of the text first; without it as under ``encode_special_tokens``, where they are ordinary text.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import regex
import tiktoken

from weftgraph.llm import kernels as K

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Slots of the table of known pre-tokens, and ids it may hold before it starts afresh.
SLOTS, POOL = 1 << 20, 1 << 23
#: The pattern whose matches are the pre-tokens; `cut` finds the same without a regex engine.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for low in range(0, 0x110000, 1 << 11):  # a part at a time: as a list all code points take a hundred MB
        every = "" if low == 0xD800 else "".join(map(chr, range(low, low + (1 << 11))))  # that part holds no characters
        for kind, pattern in ((SPACE, r"\p{White_Space}+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                out[low + m.start() : low + m.end()] = kind
    return out


def cut(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts begin; ``points``: code points of all texts, ``starts``: where each text begins."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = classes()[points]
    edge = np.ones(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[starts] = True
    run = np.flatnonzero(edge)
    begin, end = run[:-1], run[1:]
    text_end = np.zeros(n + 1, bool)
    text_end[starts] = text_end[n] = True
    is_start = edge[:n].copy()
    # The last space of a run goes with what follows it, or stands alone if it isn't a blank.
    space = (kind[begin] == SPACE) & ~text_end[end]
    last = end[space] - 1
    blank = points[last] == 0x20
    is_start[last] = True
    is_start[last[blank] + 1] = False
    # An apostrophe that begins a pre-token takes a following s, t, m, d, re, ve or ll.
    quote = begin[(end - begin == 1) & (points[begin] == 0x27) & ~text_end[end]]
    quote = quote[is_start[quote] & (kind[quote + 1] == LETTER)]
    if len(quote):
        after = points[quote + 1]
        two = points[np.minimum(quote + 2, n - 1)]
        pair = ~text_end[np.minimum(quote + 2, n)] & (((after == 0x72) & (two == 0x65)) | ((after == 0x76) & (two == 0x65)) | ((after == 0x6C) & (two == 0x6C)))
        one = np.isin(after, [0x73, 0x74, 0x6D, 0x64])
        quote, length = quote[pair | one], np.where(one, 2, 3)[pair | one]
        is_start[quote + 1] = False
        stop = quote + length
        stop = stop[(stop < n)]
        is_start[stop] = True
    return np.flatnonzero(is_start)


def _bytes_of_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in shown}
    return out | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}


class Tokenizer:
    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        tokens, symbol = model.get("added_tokens", []), _bytes_of_symbols()
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in tokens):
            raise ValueError("added tokens that look at their neighbours aren't supported")
        special = {x["content"] for x in tokens}
        self.added = {x["content"]: x["id"] for x in tokens}
        self.split = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        ranks = {bytes(symbol[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in special}
        self.piece = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.reset()

    def reset(self) -> None:
        self.key = np.zeros(SLOTS, np.uint64)
        self.at, self.length, self.chars = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.piece(p.encode()) for p in pieces]
        length = np.fromiter(map(len, ids), np.int32, len(ids))
        at = self.used + np.cumsum(length) - length
        to = self.used + int(length.sum())
        if to > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(to, len(self.pool)), np.uint32)])
        self.pool[self.used : to] = np.fromiter((x for y in ids for x in y), np.uint32, to - self.used)
        self.used = to
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        self.key[slot] = hashes
        stays = self.key[slot] == hashes  # of two in one slot, whichever stays must be whole
        slot = slot[stays]
        self.at[slot], self.length[slot], self.chars[slot] = at[stays], length[stays], np.fromiter(map(len, pieces), np.int64, len(pieces))[stays]
        return at, length

    def _encode_added(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of texts some of which hold added tokens: what lies between these is cut on its own."""
        pieces, owner, token = [], [], []  # each piece, its text, and the id that follows it, or -1
        for i, text in enumerate(texts):
            at = 0
            for m in self.split.finditer(text):
                pieces.append(text[at : m.start()])
                owner.append(i)
                token.append(self.added[m.group()])
                at = m.end()
            pieces.append(text[at:])
            owner.append(i)
            token.append(-1)
        ids, sizes = self.encode(pieces)
        token = np.array(token)
        here = token >= 0
        out = np.insert(ids, np.cumsum(sizes)[here], token[here].astype(np.uint32))
        return out, np.bincount(owner, sizes + here, len(texts)).astype(np.int64)

    def encode(self, texts: list[str], added: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and how many each has. A few MB of text at a time."""
        if added and self.split and any(x in t for t in texts for x in self.added):
            return self._encode_added(texts)
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        begin = cut(points, (ends - sizes)[sizes > 0])
        if not len(begin):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        if self.used > POOL:
            self.reset()
        end = np.append(begin[1:], len(points))
        h = np.empty(len(begin), np.uint64)
        a = 0
        while a < len(begin):  # a part at a time: codes take eight bytes for each character
            b = max(a + 1, int(np.searchsorted(end, begin[a] + 2 * K.BLOCK)))
            h[a:b] = K.piece_hashes(K.mix(points[begin[a] : end[b - 1]].astype(np.uint64) + np.uint64(0x1234567)), begin[a:b] - begin[a])
            a = b
        h |= np.uint64(1) << np.uint64(63)  # no key is 0
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        at, length = self.at[slot].astype(np.int64), self.length[slot].astype(np.int64)
        miss = np.flatnonzero((self.key[slot] != h) | (self.chars[slot] != end - begin))
        if len(miss):
            new, first, which = np.unique(h[miss], return_index=True, return_inverse=True)
            first = miss[first]
            place, size = self._learn(new, [joined[b:e] for b, e in zip(begin[first].tolist(), end[first].tolist(), strict=True)])
            at[miss], length[miss] = place[which], size[which]
        sums = np.cumsum(length)
        ids = self.pool[np.repeat(at - (sums - length), length) + np.arange(sums[-1])]
        owner = np.searchsorted(begin, ends)
        upto = np.concatenate([[0], sums])[owner]
        return ids, np.diff(np.concatenate([[0], upto]))


@cache
def tokenizer(path: str | None = None) -> Tokenizer:
    """One for each worker process and file; without a path, the public 50k byte-level file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Tokenizer(path)

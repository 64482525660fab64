"""Byte-level BPE: pre-tokens found by array operations, and a bounded memory of what they give."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable
from functools import cache

import numpy as np

from tidelog.llm.textscan import LETTER, SPACE, classes, prefix_hash, span_hash

#: Pre-tokens of more code points are not remembered: each is worked out where it stands.
LONG = 64
SLOTS = 21


def piece_starts(cps: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of the byte-level pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ in each document."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    cls = classes()[cps]
    fresh = np.zeros(n + 1, bool)
    fresh[bounds] = True
    run = np.ones(n, bool)
    run[1:] = (cls[1:] != cls[:-1]) | fresh[1:n]
    white, start = cls == SPACE, run.copy()
    same = ~fresh[1:n]
    start[1:] &= ~(run[1:] & ~white[1:] & (cps[:-1] == 32) & same)  # a space goes with what follows it
    start[:-1] |= white[:-1] & ~white[1:] & same  # the last of several spaces leaves the others
    quote = np.flatnonzero((cps[:-1] == 39) & start[:-1] & (cls[1:] == LETTER) & same)
    if len(quote):
        after = np.append(cps, [0, 0])
        one, two = after[quote + 1], after[quote + 2]
        two = np.where((quote + 2 < n) & ~fresh[np.minimum(quote + 2, n)], two, 0)
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where(long, 2, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        rest = quote + 1 + size
        rest = rest[rest < n]
        rest = rest[~fresh[rest] & (cls[rest] == LETTER)]
        start[rest] = True
    return np.flatnonzero(start)


def vocabulary(file: bytes) -> tuple[dict[bytes, int], dict[int, int], dict[str, int]]:
    """Of a byte-level BPE .json: ids by byte string; (rank << 20 | merged id) by (left << 20 | right);
    ids of special strings. Bytes stand in the file as printable characters: printable ones as
    themselves, the others from U+0100 on."""
    model = json.loads(file)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {x["content"]: x["id"] for x in model["added_tokens"] if x["special"]}
    raw = {t: i for t, i in model["model"]["vocab"].items() if t not in special}
    pairs = {}
    for rank, pair in enumerate(model["model"]["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        pairs[raw[left] << 20 | raw[right]] = rank << 20 | raw[left + right]
    return {bytes(byte[c] for c in t): i for t, i in raw.items()}, pairs, special


def merged(symbols: list[int], pairs: dict[int, int]) -> int:
    """Tokens left when the lowest-ranked adjacent pair, the leftmost of equals, is merged again
    and again: initial symbols minus merges. A heap orders the pairs, linked lists hold the
    neighbours, a pair that has gone is known by its rank when popped."""
    n = len(symbols)
    if n < 2:
        return n
    get = pairs.get
    heap = []
    for i in range(n - 1):
        if (p := get(symbols[i] << 20 | symbols[i + 1])) is not None:
            heap.append((p, i))
    heapq.heapify(heap)
    after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
    symbols = symbols[:]
    while heap:
        p, i = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] < 0 or get(symbols[i] << 20 | symbols[j]) != p:
            continue
        symbols[i], symbols[j] = p & 0xFFFFF, -1
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (q := get(symbols[i] << 20 | symbols[k])) is not None:
                heapq.heappush(heap, (q, i))
        if (h := before[i]) >= 0 and (q := get(symbols[h] << 20 | symbols[i])) is not None:
            heapq.heappush(heap, (q, h))
    return left


class Memory:
    """A value for each pre-token, from a direct-mapped table of 2^SLOTS; a miss is worked out
    once per chunk and takes its slot. Its size does not depend on the input."""

    def __init__(self, work: Callable[[str], int]):
        self.work = work
        self.keys, self.values = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int64)

    def forget(self) -> None:
        self.keys[:] = 0

    def of(self, cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        key = span_hash(prefix_hash(cps), start, end)
        slot = (key >> np.uint64(64 - SLOTS)).astype(np.int64)
        out = self.values[slot]
        long = end - start > LONG
        new = np.flatnonzero((self.keys[slot] != key) & ~long)
        if len(new):
            _, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            worked = np.fromiter((self.work(text(cps, start[i], end[i])) for i in new[first].tolist()), np.int64, len(first))
            out[new] = worked[back]
            self.keys[slot[new[first]]], self.values[slot[new[first]]] = key[new[first]], worked
            # two new pre-tokens may share a slot: the last key and the last value both stay
        for i in np.flatnonzero(long).tolist():
            out[i] = self.work(text(cps, start[i], end[i]))
        return out


def text(cps: np.ndarray, start: int, end: int) -> str:
    return cps[start:end].tobytes().decode("utf-32-le", "surrogatepass")


def split_special(texts: list[str | None], special: dict[str, int]) -> tuple[list[str], np.ndarray, list[int]]:
    """Texts cut at special strings: parts, the document of each, and the special id before each (-1: none)."""
    parts, owner, mark = [], [], []
    for i, t in enumerate(texts):
        pieces = [(-1, t or "")]
        for s, number in special.items():
            if any(s in p for _, p in pieces):
                pieces = [(before if k == 0 else number, x) for before, p in pieces for k, x in enumerate(p.split(s))]
        for before, p in pieces:
            parts.append(p)
            owner.append(i)
            mark.append(before)
    return parts, np.array(owner, np.int64), mark


@cache
def encoder(file: bytes):
    """A library encoder for single pre-tokens, with this file's ids."""
    import tiktoken

    ranks, _, special = vocabulary(file)
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), special

"""Whole texts as code point arrays: chunks, character classes, substring hashes.

A chunk holds whole documents laid end to end, up to `CHUNK` code points (one longer document
is a chunk of its own), so memory is bounded by CHUNK and the longest text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
OTHER, LETTER, NUMBER, SPACE = range(4)
#: The code points with Unicode's White_Space property.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BASE = 0x9E3779B97F4A7C15 | 1


@cache
def classes() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE of each code point."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = SPACE
    return table


@cache
def lower() -> np.ndarray:
    """The lower-case code point of each one; itself where lower case takes several."""
    low = (chr(c).lower() for c in range(0x110000))
    return np.fromiter((ord(x) if len(x) == 1 else c for c, x in enumerate(low)), np.uint32, 0x110000)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(size, BASE, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def chunks(texts: list[str | None] | pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, code points, bounds): documents first..end-1 lie at bounds[i]..bounds[i+1]. Of an Arrow column only
    a chunk's texts are Python strings at a time."""
    held = isinstance(texts, list)
    lens = [len(t) if t else 0 for t in texts] if held else pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
    first, size = 0, 0
    for i in range(len(lens) + 1):
        if i == len(lens) or size and size + lens[i] > CHUNK:
            if i > first:
                part = texts[first:i] if held else texts.slice(first, i - first).to_pylist()
                raw = "".join(t or "" for t in part).encode("utf-32-le", "surrogatepass")
                bounds = np.zeros(i - first + 1, np.int64)
                np.cumsum(lens[first:i], out=bounds[1:])
                yield first, i, np.frombuffer(raw, np.uint32), bounds
            first, size = i, 0
        if i < len(lens):
            size += lens[i]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums from which `span_hash` gets any substring's polynomial hash modulo 2^64."""
    up, _ = _powers(_room(len(values)))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of values[start:end]; equal spans have equal hashes at any place."""
    _, down = _powers(_room(len(sums) - 1))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _room(n: int) -> int:
    return max(CHUNK, 1 << max(0, n).bit_length())


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(cls: np.ndarray, bounds: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of a class; a run never crosses documents."""
    inside = np.zeros(len(cls) + 2, np.int8)
    inside[1:-1] = cls == kind
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(cls))]
    cut = np.unique(cut[(inside[cut + 1] == 1) & (inside[cut] == 1)]) if len(cut) else cut
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end


def per_doc(values: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of `values`, which stand at ascending places `at`, for each document."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    edge = np.searchsorted(at, bounds)
    return total[edge[1:]] - total[edge[:-1]]

"""Words and word shingles of many texts at once, as 64-bit hashes, in numpy.

A word is a run of bytes other than space and 0x09-0x0D.  A word's hash is a polynomial over
its bytes modulo 2**64, taken from prefix sums, so that no loop over words is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    size = CHUNK
    while size < n:
        size *= 2
    if size not in _tables:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _tables[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        for other in [k for k in _tables if k not in (CHUNK, size)]:
            del _tables[other]
    return _tables[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte buffer."""
    flags = np.ones(len(buf) + 2, np.int8)
    flags[1:-1] = _SPACE[buf]
    edges = np.flatnonzero(np.diff(flags))
    return edges[0::2], edges[1::2]


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, in pieces of about CHUNK bytes so that memory stays bounded."""
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
        high = ends[last - 1]
        up, down = _powers(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((buf[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = mix((sums[e] - sums[s]) * down[s])
        first = last
    return out


def texts_to_words(texts: list[bytes | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the texts' offsets into them (one more than texts)."""
    parts = [t or b"" for t in texts]
    buf = np.frombuffer(b"\n".join(parts), np.uint8)
    if lower:
        buf = _LOWER[buf]
    begin = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=begin[1:])
    starts, ends = split_words(buf)
    return hash_words(buf, starts, ends), np.searchsorted(starts, begin)


def combine(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k successive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for t in range(k):
        out += words[t : t + n] * np.uint64(pow(0xD1342543DE82EF95, t + 1, 1 << 64) | 1)
    return mix(out)


def shingle_sets(texts: list[bytes | None], k: int, lower: bool = True) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; of fewer words, the one of all of them."""
    words, at = texts_to_words(texts, lower)
    every = combine(words, k)
    out = []
    for i in range(len(texts)):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        elif b > a:
            out.append(combine(words[a:b], b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def slices(values: list, weight, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of values whose weights sum to about most; at least one value each."""
    first, total = 0, 0
    for i, v in enumerate(values):
        w = weight(v)
        if i > first and total + w > most:
            yield first, i
            first, total = i, 0
        total += w
    if first < len(values):
        yield first, len(values)

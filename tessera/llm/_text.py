"""Whole-batch text arithmetic on UTF-8 bytes.

The separators are the ASCII bytes 0x20 and 0x09-0x0D, so cutting bytes is the
same as cutting code points. All functions take the concatenated bytes of many
documents and their offsets, and never look across a document boundary.
"""

from __future__ import annotations

import hashlib

import numpy as np

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = np.add(x, _A)
    if x.ndim == 0:
        x = (x ^ (x >> U(30))) * _B
        x = (x ^ (x >> U(27))) * _C
        return x ^ (x >> U(31))
    part = np.empty_like(x)
    for shift, factor in ((U(30), _B), (U(27), _C), (U(31), None)):
        x ^= np.right_shift(x, shift, out=part)
        if factor is not None:
            x *= factor
    return x


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each document its first word's index (n+1 values)."""
    inside = ~SEPARATOR[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = offs[:-1][offs[:-1] < offs[1:]]
    start[full] = inside[full]
    last = offs[1:][offs[:-1] < offs[1:]] - 1
    end[last] = inside[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def eights(data: np.ndarray) -> np.ndarray:
    """At each position the eight bytes from there on, little-endian; zeros follow the end."""
    buf = np.zeros(len(data) + 8, np.uint8)
    buf[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", buf, 0, (1,))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    lens = ends - starts
    view = eights(data)
    # most spans end within the first eight bytes, which all are taken at once
    short = np.minimum(lens, _LONG + 1)
    h = _LENGTHS[short]
    first = view[starts]
    first &= _BELOW[np.minimum(short, 8)]
    first *= _C
    first ^= h
    h = mix(first)
    empty = np.flatnonzero(lens <= 0)
    h[empty] = mix(lens[empty].astype(U))
    act = np.flatnonzero((lens > 8) & (lens <= _LONG))
    k = 8
    while len(act):
        rem = lens[act] - k
        chunk = view[starts[act] + k]
        part = rem < 8
        chunk = np.where(part, chunk & ((U(1) << (U(8) * np.minimum(rem, 7).astype(U))) - U(1)), chunk)
        h[act] = mix(h[act] ^ (chunk * _C))
        act, k = act[rem > 8], k + 8
    for i in np.flatnonzero(lens > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


#: The hashes of lengths, and the bytes of an eight that belong to a span of at most eight.
_LENGTHS = mix(np.arange(_LONG + 2, dtype=U))
_BELOW = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles, not yet distinct, and the documents' offsets in them.

    A document with fewer than k words has its whole sequence as one shingle;
    one without words has none.
    """
    n, docs = len(hashes), len(first) - 1
    count = np.diff(first)
    out = np.maximum(count - k + 1, (count > 0).astype(count.dtype))
    offs = np.zeros(docs + 1, np.int64)
    np.cumsum(out, out=offs[1:])
    res = np.empty(int(offs[-1]), U)
    if n >= k:
        h = mix(hashes[: n - k + 1])
        for j in range(1, k):
            h = mix(h ^ (hashes[j : n - k + 1 + j] * _B))
        own = np.repeat(np.arange(docs), out)
        long = count[own] >= k
        at = (first[:-1] - offs[:-1])[own] + np.arange(len(res))
        res[long] = h[at[long]]
    for d in np.flatnonzero((count > 0) & (count < k)):
        h = mix(hashes[first[d] : first[d] + 1] ^ U(count[d]))
        for j in range(1, count[d]):
            h = mix(h ^ (hashes[first[d] + j : first[d] + j + 1] * _B))
        res[offs[d]] = mix(h ^ _C)[0]
    return res, offs


def distinct_sets(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct values in ascending order, and their offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    sizes = np.zeros(len(offs), np.int64)
    np.cumsum([len(p) for p in parts], out=sizes[1:])
    return (np.concatenate(parts) if parts else values[:0]), sizes

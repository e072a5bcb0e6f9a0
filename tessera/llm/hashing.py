"""Vectorised 64-bit hashes without algebraic structure.

A polynomial modulo 2^64 gives equal sums for some regular strings of a thousand
symbols whatever its base, so wherever equal numbers stand for equal text the
hash mixes at every step (``strings``) or draws a random number for each place
and byte (``spans``). Two functions of one input are independent (``nr``).
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np

U = np.uint64
#: Bytes of a span that have a row of their own in the table; longer spans are hashed one by one.
PLACES = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which every bit depends on all."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(29)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(32)
    return x


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * U(0x9E3779B97F4A7C15)
    x += b
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    return x


def strings(sym: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive symbols (hashed ones), by doubling; the last step may overlap."""
    h, size = sym, 1
    while size * 2 <= k:
        h = _joined(h[:-size], h[size:]) if len(h) > size else h[:0]
        size *= 2
    rest = k - size
    return h if not rest else _joined(h[:-rest], h[rest:]) if len(h) > rest else h[:0]


@functools.lru_cache(maxsize=2)
def _table(nr: int) -> np.ndarray:
    """A random number for each place and byte."""
    return np.random.default_rng(1000 + nr).integers(0, 2**64, PLACES * 256, dtype=np.uint64)


def spans(data: np.ndarray, start: np.ndarray, stop: np.ndarray, count: int = 1, chunk: int = 1 << 16) -> list[np.ndarray]:
    """count independent hashes of each span start..stop (not empty) of bytes."""
    out = [np.empty(len(start), U) for _ in range(count)]
    size = stop - start
    long = size > PLACES
    short = np.flatnonzero(~long)
    ends = np.cumsum(size[short])
    lo = 0
    while lo < len(short):
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + chunk)), lo + 1)
        n = size[short[lo:hi]]
        at = np.cumsum(n) - n
        place = np.arange(int(n.sum()), dtype=np.int64)
        source = place + np.repeat(start[short[lo:hi]] - at, n)
        slot = ((place - np.repeat(at, n)) << 8) + data[source]
        for nr in range(count):
            out[nr][short[lo:hi]] = np.add.reduceat(_table(nr)[slot], at)
        lo = hi
    for i in np.flatnonzero(long).tolist():
        digest = hashlib.blake2b(data[start[i] : stop[i]].tobytes(), digest_size=16).digest()
        for nr, x in enumerate(np.frombuffer(digest, "<u8")[:count]):
            out[nr][i] = x
    return [mixed(x) for x in out]


def distinct(a: np.ndarray) -> np.ndarray:
    """The distinct numbers of a, sorted."""
    a = np.sort(a)
    new = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=new[1:])
    return a[new]


@functools.lru_cache(maxsize=16)
def even_keys(n: int) -> np.ndarray:
    """An int for each of n partitions that Spark's hash of ints (Murmur3 with seed 42) deals there, so that n buckets take n tasks."""
    v = np.arange(16 * n + 400, dtype=np.uint32)
    with np.errstate(over="ignore"):
        k = v * np.uint32(0xCC9E2D51)
        k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
        h = np.uint32(42) ^ k
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
    part = h.view(np.int32).astype(np.int64) % n
    first, at = np.unique(part, return_index=True)
    assert len(first) == n
    return v[at].astype(np.int64)

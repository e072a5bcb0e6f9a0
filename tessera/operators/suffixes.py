"""Suffix arrays, searches on them, longest common prefixes and Burrows-Wheeler transforms of each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _levels(data: bytes) -> list[np.ndarray]:
    """Ranks of the strings of 1, 2, 4, ... bytes at each place; in the last all differ."""
    n = len(data)
    rank = np.frombuffer(data, np.uint8).astype(np.int64) + 1
    out, size = [rank], 1
    while n and size < n:
        after = np.zeros(n, np.int64)
        after[: n - size] = rank[size:]
        key = rank * (rank.max() + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[1], 1 + np.cumsum(key[order][1:] != key[order][:-1])])
        rank, size = new, size * 2
        out.append(rank)
        if rank.max() == n:
            break
    return out


def suffix_array_of(data: bytes) -> np.ndarray:
    """Places of suffixes in byte order, by doubling."""
    return np.argsort(_levels(data)[-1], kind="stable")


def suffixes_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places of suffixes in order, the common prefix of each with the one before it; the first has 0).

    Common prefixes grow by the largest strings whose ranks agree, all pairs at once.
    """
    levels = _levels(data)
    places = np.argsort(levels[-1], kind="stable")
    n = len(data)
    common = np.zeros(n, np.int64)
    if n > 1:
        a, b, size = places[:-1].copy(), places[1:].copy(), np.zeros(n - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            rank = levels[k]
            inside = (a < n) & (b < n)
            same = np.zeros(n - 1, bool)
            same[inside] = rank[a[inside]] == rank[b[inside]]
            step = same.astype(np.int64) << k
            a, b, size = a + step, b + step, size + step
        common[1:] = size
    return places, common


def _bounds(data: bytes, places: np.ndarray, pattern: bytes) -> tuple[int, int]:
    """Ranks of the first suffix not below the pattern, and of the first behind those that begin with it."""

    def first(behind: bool) -> int:
        lo, hi = 0, len(places)
        while lo < hi:
            mid = (lo + hi) // 2
            head = data[places[mid] : places[mid] + len(pattern)]
            if head < pattern or (behind and head == pattern):
                lo = mid + 1
            else:
                hi = mid
        return lo

    return first(False), first(True)


def suffix_array(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nr, pos, lcp) of each text's UTF-8."""
    kind = texts.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            each = [suffixes_of((t or "").encode()) for t in pdf[text]]
            sizes = np.array([len(p) for p, _ in each], np.int64)
            start = np.cumsum(sizes) - sizes
            yield pd.DataFrame({
                key: np.repeat(pdf[key].to_numpy(), sizes), "nr": np.arange(sizes.sum()) - np.repeat(start, sizes),
                "pos": np.concatenate([p for p, _ in each]) if each else sizes, "lcp": np.concatenate([c for _, c in each]) if each else sizes,
            })

    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, nr long, pos long, lcp long")


def search(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, first, n): rank of the first suffix not below the pattern, and how many begin with it; by binary search."""
    kind, wanted = texts.schema[key].dataType.simpleString(), pattern.encode()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [_bounds(d, suffix_array_of(d), wanted) for d in ((t or "").encode() for t in pdf[text])]
            yield pd.DataFrame({key: pdf[key].to_numpy(), "first": [a for a, _ in found], "n": [b - a for a, b in found]})

    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, first long, n long")


def bwt(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bwt binary): the byte before each suffix, the last byte before the first place."""
    kind = texts.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            data = [np.frombuffer((t or "").encode(), np.uint8) for t in pdf[text]]
            yield pd.DataFrame({key: pdf[key], "bwt": [d[suffix_array_of(d.tobytes()) - 1].tobytes() for d in data]})

    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, bwt binary")


class Dictionary:
    """Longest matches of an input against a text, by its suffix array."""

    def __init__(self, words: bytes) -> None:
        self.words, self.places = words, suffix_array_of(words)

    def narrowed(self, lo: int, hi: int, depth: int, byte: int) -> tuple[int, int]:
        """Of the suffixes lo..hi - 1, which agree in depth bytes, those whose next byte is byte."""

        def first(value: int) -> int:
            a, b = lo, hi
            while a < b:
                mid = (a + b) // 2
                at = self.places[mid] + depth
                if (self.words[at] if at < len(self.words) else -1) < value:
                    a = mid + 1
                else:
                    b = mid
            return a

        return first(byte), first(byte + 1)

    def longest(self, data: bytes, at: int, most: int = 1 << 16) -> tuple[int, int]:
        """(place in the text, length) of the longest match of data from at on; the least place of the range that is left."""
        lo, hi, n = 0, len(self.places), 0
        while at + n < len(data) and n < most:
            a, b = self.narrowed(lo, hi, n, data[at + n])
            if a == b:
                break
            lo, hi, n = a, b, n + 1
        return (int(self.places[lo]), n) if n else (0, 0)

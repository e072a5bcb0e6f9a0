"""Distinct words of a batch of texts, found by hashing the text's bytes as a whole.

Work per word is done in numpy; Python objects are made for distinct words only.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.hashing import spans

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of texts: of word i, ``label[i]`` is its number among distinct words, ``doc[d]:doc[d+1]`` are the words of text d.

    space: the bytes that part words. ``key`` and ``check``: two independent 64-bit hashes of each distinct word, equal
    for equal words in any batch. ``sound``: the second agrees that words with one key are equal.

    kind: for bytes, 0 or the kind of a plain word's byte; lead and not_after: the one first byte of two-byte letters
    and second bytes that make none. A word of plain bytes alone is cut where the kind changes (``plain``), and with
    fold words that differ in the case of A-Z are one.
    """

    def __init__(self, texts: list[str], space: bytes, kind: np.ndarray | None = None, lead: int = 0, not_after: tuple[int, ...] = (), fold: bool = False) -> None:
        raw = [t.encode("utf-8") for t in texts]
        self.data = b"\n".join(raw)
        buf = np.frombuffer(self.data + b"\n", np.uint8)
        is_space = np.zeros(256, bool)
        is_space[list(space)] = True
        gap = is_space[buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate([[0], edge])
        start, stop = edge[0::2], edge[1::2]
        plain = np.zeros(len(start), bool)
        if kind is not None and len(start):
            of = kind[buf]
            odd = of == 0
            odd &= ~gap
            second = np.flatnonzero((buf >= 0x80) & (buf < 0xC0))
            bad = buf[second - 1] != lead
            for b in not_after:
                bad |= buf[second] == b
            odd[second[bad]] = True
            plain = np.add.reduceat(odd, start, dtype=np.int32) == 0
            cut = np.flatnonzero((of[1:] != of[:-1]) & ~gap[1:] & ~gap[:-1]) + 1
            cut = cut[plain[np.searchsorted(start, cut, "right") - 1]]
            order = np.argsort(np.concatenate([start, cut]), kind="stable")
            plain = np.concatenate([plain, np.ones(len(cut), bool)])[order]
            start, stop = np.concatenate([start, cut])[order], np.sort(np.concatenate([stop, cut]))
        read = _LOWER[buf] if fold else buf
        first, second = spans(read, start, stop, 2)
        self.key, at, self.label = np.unique(first, return_index=True, return_inverse=True)
        self.check = second[at]
        self.sound = bool((second == self.check[self.label]).all())
        self.plain, self._start, self._stop = plain[at], start[at], stop[at]
        begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
        self.doc = np.searchsorted(start, begins)

    def __len__(self) -> int:
        return len(self.key)

    def raw(self, k: np.ndarray) -> list[bytes]:
        """Distinct words k as UTF-8."""
        data = self.data
        return [data[i:j] for i, j in zip(self._start[k].tolist(), self._stop[k].tolist())]


def word_hashes(texts: list[str], space: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of each word, words of each text); fold: A-Z and a-z are the same."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    is_space = np.zeros(256, bool)
    is_space[list(space)] = True
    gap = is_space[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    start, stop = edge[0::2], edge[1::2]
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return spans(_LOWER[buf] if fold else buf, start, stop)[0], np.diff(np.searchsorted(start, begins))

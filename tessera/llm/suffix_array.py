"""Exact byte deduplication by prefix-free parsing and suffix arrays.

Text that shares no window with another document is settled beforehand
(``repeats``). In each group of the rest, places where a rolling hash of the
next bytes is 0 modulo a number are triggers. They cut the text into phrases,
each of which runs on through the next trigger. Copies have the same phrases, so
the dictionary of distinct phrases stays small however often they repeat. The
suffixes of the dictionary and those of the parse (the phrases as numbers) are
sorted; together they give the order of all suffixes of the group's text: first
by what is left of the phrase, then by the phrases that follow. No phrase suffix
is a prefix of another, so this is the order of the text itself. Neighbours in
it that agree in ``width`` bytes are one string.

Rule: a byte goes if a string of ``width`` bytes that covers it also starts in a
document with a smaller id; strings never cross documents and are judged on the
input.

Edge cases: a null or empty text has no bytes; shorter texts keep all; rows with
equal ids do not remove each other's bytes, and each gets its own result; rows
with a null id are returned whole and remove nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import hashing, repeats
from tessera.llm.common import pieces

WIDTH, ANCHOR = 50, 24
#: Bytes of a trigger, and the modulus of its hash: phrases have about as many bytes.
TRIGGER, MODULUS = 6, 16
#: Symbols (at most 256, so 9 bits each) compared at once.
PACK = 6
#: A fixed random number for each byte and, first, for a text's end.
_TABLE = np.random.default_rng(7).integers(1, 2**63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _symbols(text: str) -> tuple[np.ndarray, bytes]:
    data = text.encode("utf-8")
    return _TABLE[np.frombuffer(data, np.uint8).astype(np.int16) + 1], data


def _cut(data: bytes, i: int, j: int) -> bytes:
    return data[i:j]


def alphabet(width: int) -> repeats.Alphabet:
    return repeats.Alphabet(_symbols, _cut, width, min(ANCHOR, width), 128_000)


def _packed(symbols: np.ndarray, stop: np.ndarray | None = None) -> np.ndarray:
    """PACK symbols from each place on as one number; 0 after stop."""
    out = np.zeros(len(symbols), np.int64)
    here = np.arange(len(symbols))
    for i in range(PACK):
        out *= 512
        out[: len(symbols) - i] += symbols[i:] + 1
        if stop is not None:
            late = np.flatnonzero(here + i >= stop)
            late = late[late < len(symbols) - i]
            out[late] -= symbols[late + i] + 1
    return out


def _sorted_suffixes(symbols: np.ndarray, stop: np.ndarray, depth: int, packed: bool) -> np.ndarray:
    """Rank, from 1, of each suffix symbols[i:stop[i]] by its first depth symbols at least; equal ones have equal ranks. By doubling."""
    rank = np.unique(_packed(symbols, stop) if packed else symbols, return_inverse=True)[1].astype(np.int64) + 1
    here, size = np.arange(len(symbols)), PACK if packed else 1
    longest = min(depth, int((stop - here).max(initial=0)))
    while size < longest:
        on = here + size
        after = np.where(on < stop, rank[np.minimum(on, len(rank) - 1)], 0)
        rank = np.unique(rank * (rank.max() + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        size *= 2
    return rank


def parsed(texts: list[bytes], trigger: int = TRIGGER, modulus: int = MODULUS):
    """The parse of texts: (symbols with an end mark after each text, text of each place, phrase begins, phrase stops, phrase ids, first of each id)."""
    sizes = np.array([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    symbols = np.zeros(ends[-1], np.int16)
    keep = np.ones(ends[-1], bool)
    keep[ends - 1] = False
    symbols[keep] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
    hashed = _TABLE[symbols]
    first = np.zeros(ends[-1], bool)
    first[ends - sizes] = True
    if len(symbols) > trigger:
        at = np.flatnonzero(repeats.mixed(repeats.grams(hashed, trigger)) % np.uint64(modulus) == 0)
        first[at[at + trigger < ends[owner[at]]]] = True
    begin = np.flatnonzero(first)
    last = np.append(owner[begin[1:]] != owner[begin[:-1]], True)
    stop = np.where(last, ends[owner[begin]], np.append(begin[1:], 0) + trigger)
    # two independent hashes tell phrases apart; the end mark is byte 255, which UTF-8 does not have
    one, two = hashing.spans((symbols - 1).astype(np.uint8), begin, stop, 2)
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(new) - 1
    sample = order[new]
    return symbols, owner, begin, stop, last, ids, sample


def corpus_order(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, text of each place, rank by what is left of the phrase, rank by the phrases that follow).

    The order of the suffixes by their first depth symbols at least.
    """
    symbols, owner, begin, stop, last, ids, sample = parsed(texts)
    # dictionary: every distinct phrase once
    size = (stop - begin)[sample]
    base = np.cumsum(size) - size
    source = np.repeat(begin[sample] - base, size) + np.arange(size.sum())
    rank = _sorted_suffixes(symbols[source], np.repeat(base + size, size), depth, True)
    # parse: a phrase by its rank in the dictionary
    phrase = rank[base[ids]]
    after_last = np.flatnonzero(last) + 1
    ends = np.repeat(after_last, np.diff(np.concatenate([[0], after_last])))
    parse = _sorted_suffixes(phrase, ends, depth, False)
    here = np.arange(len(symbols))
    nr = np.searchsorted(begin, here, "right") - 1
    left = rank[base[ids[nr]] + here - begin[nr]]
    follow = np.where(last[nr], 0, parse[np.minimum(nr + 1, len(parse) - 1)])
    return symbols, owner, left, follow


def _repeated(texts: list[bytes], width: int) -> np.ndarray:
    """Numbers of the texts with a window whose hash another place has too; no others have equal windows."""
    sizes = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    hashed = _TABLE[np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1]
    if len(hashed) < width:
        return np.empty(0, np.int64)
    inside = np.flatnonzero(owner[: len(owner) - width + 1] == owner[width - 1 :])
    windows = repeats.grams(hashed, width)[inside]
    order = np.argsort(windows)
    windows = windows[order]
    same = np.zeros(len(order), bool)
    same[1:] = windows[1:] == windows[:-1]
    same[:-1] |= same[1:]
    return np.unique(owner[inside[order[same]]])


def equal_windows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, class) of each window of width bytes in texts that have any in common."""
    some = _repeated(texts, width)
    if not len(some):
        return some, some, some
    text, place, label = _equal_windows([texts[i] for i in some], width)
    return some[text], place, label


def _equal_windows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, class) of each window of width bytes."""
    symbols, owner, left, follow = corpus_order(texts, width)
    sizes = np.array([len(t) for t in texts])
    place = np.arange(len(symbols)) - (np.cumsum(sizes + 1) - sizes - 1)[owner]
    at = np.flatnonzero(place + width <= sizes[owner])
    at = at[np.argsort(left[at] * (follow.max(initial=0) + 1) + follow[at], kind="stable")]
    same = np.ones(max(len(at) - 1, 0), bool)
    several = _packed(symbols)
    for i in [*range(0, width - PACK, PACK), width - PACK] if width >= PACK else range(width):
        todo = np.flatnonzero(same)
        a, b = at[todo] + i, at[todo + 1] + i
        same[todo] = several[a] == several[b] if width >= PACK else symbols[a] == symbols[b]
    return owner[at], place[at], np.concatenate([[0], np.cumsum(~same)]) if len(at) else at


def covered(rows: DataFrame, width: int) -> DataFrame:
    def equal(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return equal_windows(found, width)

    def windows_of(piece: bytes) -> list[bytes]:
        return [piece[i : i + width] for i in range(len(piece) - width + 1)]

    return repeats.covered(rows, alphabet(width), equal, windows_of)


def deduplicated(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans, kept_sha256) of every row; kept: the bytes that stay, null where all do."""
    rows = repeats.versions(docs, id_col, text_col)
    letters = alphabet(width)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(frames, "text", letters.chunk):
            kept, removed, n = [], [], []
            for text, found in zip(pdf["text"], repeats.removed(letters, pdf)):
                data, out, at = text.encode(), [], 0
                for a, b in found:
                    out.append(data[at:a])
                    at = b
                kept.append(b"".join([*out, data[at:]]))
                removed.append(len(data) - len(kept[-1]))
                n.append(len(found))
            yield pd.DataFrame({"cut_id": pdf["doc_id"], "cut_version": pdf["version"], "kept": kept, "n_removed": removed, "n_spans": n, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]})

    changed = covered(rows, width).mapInPandas(cut, "cut_id long, cut_version long, kept binary, n_removed long, n_spans long, kept_sha256 string")
    text = F.coalesce("text", F.lit(""))
    every = rows.select("doc_id", "version", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    joined = every.join(changed, (F.col("doc_id") == F.col("cut_id")) & (F.col("version") == F.col("cut_version")), "left")
    zero = F.lit(0).cast("long")
    return joined.select("doc_id", "kept", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


#: The contract in DuckDB's SQL, on hexadecimal digits.
SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, h, unnest(range(0, strlen(h) // 2 - 49)) AS s FROM d WHERE strlen(h) >= 100),
x AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS win FROM s),
f AS (SELECT win, min(doc_id) AS least FROM x GROUP BY win HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT x.doc_id AS doc_id, unnest(range(s, s + 50)) AS q FROM x JOIN f ON x.win = f.win WHERE x.doc_id > f.least),
n AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE prev IS NULL OR prev < q - 1) AS n_spans FROM (SELECT doc_id, q, lag(q) OVER (PARTITION BY doc_id ORDER BY q) AS prev FROM g) GROUP BY doc_id),
e AS (SELECT doc_id, h, unnest(range(0, strlen(h) // 2)) AS q FROM d),
k AS (SELECT e.doc_id AS doc_id, string_agg(substr(h, 2 * e.q + 1, 2), '' ORDER BY e.q) AS kept FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.q = g.q WHERE g.q IS NULL GROUP BY e.doc_id)
SELECT d.doc_id AS doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""

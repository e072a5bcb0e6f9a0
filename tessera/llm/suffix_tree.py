"""Exact substring deduplication with prefix-partitioned suffix trees over words.

Suffixes that share no window with another document are settled beforehand
(``repeats``). The rest is split by prefixes of varying length: by the anchor
inside their first window (8 words), and where one anchor has more classes than
a group may hold, by the whole window (50 words). For each group a suffix tree,
cut off behind the window's depth, is built as its leaves in order with the words
that neighbours share. Its deep internal nodes, those with at least a window's
words above two leaves, give the repeats: their paths, joined where they
overlap, are the maximal repeats, and a node's least document keeps the text.

Rule: a word goes if a window of ``width`` words that covers it also starts in a
document with a smaller id; windows are judged on the input.

Edge cases: a null or empty text has no words; a text shorter than a window
keeps all; rows with equal ids do not remove each other's words, and each gets
its own result; rows with a null id are returned whole and remove nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import repeats
from tessera.llm.common import WORD, each_row, pieces

_WORDS = re.compile(WORD).findall
WIDTH, ANCHOR = 50, 8


def _symbols(text: str) -> tuple[np.ndarray, list[str]]:
    words = _WORDS(text)
    if not words:
        return np.empty(0, np.uint64), words
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False), words


def _cut(words: list[str], i: int, j: int) -> bytes:
    return " ".join(words[i:j]).encode()


def alphabet(width: int) -> repeats.Alphabet:
    return repeats.Alphabet(_symbols, _cut, width, min(ANCHOR, width), 1_000_000)


def subtree(segments: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, place, common, node) of the leaves of a group's suffix tree in order, cut off at about depth words.

    Leaves are suffixes with at least depth words. common: words that a leaf shares with the one before it (0 for the
    first). node: the number of the deep internal node above the leaf, the highest one with at least depth words, or
    -1: an interval of neighbours that share so many words.
    """
    sizes = np.array([len(s) for s in segments], np.int64)
    word = pd.factorize(np.array([w for s in segments for w in s], dtype=object))[0].astype(np.int64) + 1
    n = len(word)
    stop = np.repeat(np.cumsum(sizes), sizes)
    here = np.arange(n)
    levels, size = [word], 1
    while size < depth:  # ranks of 1, 2, 4, ... words; a segment's end comes before all words
        on = here + size
        after = np.where(on < stop, levels[-1][np.minimum(on, n - 1)], 0)
        key = levels[-1] * (int(levels[-1].max(initial=0)) + 1) + after
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], key[order][1:] != key[order][:-1]])) if n else 0
        levels.append(rank)
        size *= 2
    leaf = np.flatnonzero(here + depth <= stop)
    leaf = leaf[np.argsort(levels[-1][leaf], kind="stable")]
    common = np.zeros(len(leaf), np.int64)
    if len(leaf) > 1:
        a, b = leaf[:-1].copy(), leaf[1:].copy()
        end_a, end_b = stop[a], stop[b]
        for k in range(len(levels) - 1, -1, -1):
            inside = (a + (1 << k) <= end_a) & (b + (1 << k) <= end_b)
            step = np.zeros(len(a), np.int64)
            step[inside] = (levels[k][a[inside]] == levels[k][b[inside]]).astype(np.int64) << k
            a, b = a + step, b + step
        common[1:] = a - leaf[:-1]
    deep = common >= depth
    node = np.cumsum(~deep) - 1
    many = np.bincount(node, minlength=1)[node] > 1 if len(node) else np.zeros(0, bool)
    start = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)[leaf]
    return owner, leaf - start[owner], common, np.where(many, node, -1)


def tree_nodes(segments: list[list[bytes]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, place, node) of each suffix below a deep internal node, whose path has at least width words."""
    owner, place, _, node = subtree(segments, width)
    below = node >= 0
    return owner[below], place[below], node[below]


def covered(rows: DataFrame, width: int) -> DataFrame:

    def equal(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tree_nodes([p.split(b" ") for p in found], width)

    def windows_of(piece: bytes) -> list[bytes]:
        words = piece.split(b" ")
        return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]

    return repeats.covered(rows, alphabet(width), equal, windows_of)


def deduplicated(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept, n_words, n_removed, kept_sha256) of every row; kept: the words that stay, null where all do."""
    rows = repeats.versions(docs, id_col, text_col)
    letters = alphabet(width)

    def base(texts: list[str]) -> dict[str, list]:
        words = [_WORDS(t) for t in texts]
        return {"n_words": [len(w) for w in words], "sha": [hashlib.sha256(" ".join(w).encode()).hexdigest() for w in words]}

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(frames, "text", letters.chunk):
            kept, removed, sha = [], [], []
            for text, found in zip(pdf["text"], repeats.removed(letters, pdf)):
                words, out, at = _WORDS(text), [], 0
                for a, b in found:
                    out += words[at:a]
                    at = b
                out += words[at:]
                kept.append(" ".join(out))
                removed.append(len(words) - len(out))
                sha.append(hashlib.sha256(kept[-1].encode()).hexdigest())
            yield pd.DataFrame({"cut_id": pdf["doc_id"], "cut_version": pdf["version"], "kept": kept, "n_removed": removed, "kept_sha256": sha})

    changed = covered(rows, width).mapInPandas(cut, "cut_id long, cut_version long, kept string, n_removed long, kept_sha256 string")
    every = each_row(rows, base, "n_words long, sha string")
    joined = every.join(changed, (F.col("doc_id") == F.col("cut_id")) & (F.col("version") == F.col("cut_version")), "left")
    return joined.select("doc_id", "kept", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


#: The contract in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50),
x AS (SELECT doc_id, s, array_to_string(w[s : s + 49], ' ') AS win FROM s),
f AS (SELECT win, min(doc_id) AS least FROM x GROUP BY win HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT x.doc_id AS doc_id, unnest(range(s, s + 50)) AS q FROM x JOIN f ON x.win = f.win WHERE x.doc_id > f.least),
n AS (SELECT doc_id, count(*) AS n_removed, list(q) AS gone FROM g GROUP BY doc_id),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
k AS (SELECT e.doc_id AS doc_id, string_agg(word, ' ' ORDER BY e.q) AS kept FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.q = g.q WHERE g.q IS NULL GROUP BY e.doc_id)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""

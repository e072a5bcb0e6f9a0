"""Near duplicates of any sets: sketches, banded buckets, star edges, exact confirmation, components.

1. A set's sketch is a one-permutation hash: keys fall into bins, each bin keeps
   its least key, and an empty bin copies from a bin that a fixed random
   sequence for it meets first (optimal densification). Equal places of two
   sketches are as likely as the sets' Jaccard similarity.
2. ``rows`` places together are a band. In each batch the least element of a
   band is its hub there; pairs (hub, other) stay with the batch's rows and only
   hubs are sent to buckets, so a bucket gets one element a batch of a band that
   very many sets share. In the bucket the band's least element is the hub of
   those. A band of n elements gives at most n - 1 pairs.
3. Pairs are confirmed on full sets, and confirmed links give components.
4. Stars may miss links between two of their rays. Stars that share elements form
   a cluster. Where a cluster is not one component, the elements outside its
   largest component meet all others of the cluster, every two once, in blocks
   that grow with the square root of a large cluster; there an inverted index of
   each set's rarest keys (so many that linked sets share one) names the pairs of
   different components, which are confirmed until they hang together.

So of two different texts that share a band no link between components is lost;
the chance that a pair at the threshold shares none is given by the operators.

Elements are (doc, nr). Copies (equal tags of 64 bits) are for the caller to join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import repeats
from tessera.llm.common import dropped, pieces, saved
from tessera.llm.components import components
from tessera.llm.hashing import distinct, mixed

U = np.uint64
#: Entries of a bucket, and rays of a hub that one task takes.
BUCKET, SALT = 1_000_000, 4096
#: Elements of a block outside a cluster's largest component, and inside it; both grow with the root of a cluster of more than LARGE.
BLOCK, OTHERS, LARGE = 512, 640, 4096
#: Tasks that share what is known of one cluster.
SHARES = 32
#: Elements of a batch at most: their numbers take 16 bits.
BATCH = 40_000


@dataclass(frozen=True)
class Sets:
    """keys(texts): (keys of all texts, how many each has), distinct and sorted within a text; loose: the same with repeats.

    Two sets are linked if 100 * intersection >= percent * union. A sketch has bands of rows places.
    """

    keys: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
    loose: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
    percent: int
    rows: int
    bands: int

    def linked(self, same, a, b):
        return 100 * same >= self.percent * (a + b - same)


def sketch(keys: np.ndarray, sizes: np.ndarray, bins: int, chunk: int = 1 << 15) -> np.ndarray:
    """uint16 sketches, one row per set; sets without keys have zeros. Works on about chunk keys at a time, which fit in a cache."""
    out, ends, lo = np.zeros((len(sizes), bins), np.uint16), np.cumsum(sizes), 0
    while lo < len(sizes):
        before = int(ends[lo - 1]) if lo else 0
        hi = min(max(int(np.searchsorted(ends, before + chunk)), lo + 1), lo + 1 + 2 * chunk // bins)
        out[lo:hi] = _sketch(keys[before : int(ends[hi - 1])], sizes[lo:hi], bins)
        lo = hi
    return out


def _sketch(keys: np.ndarray, sizes: np.ndarray, bins: int) -> np.ndarray:
    n = len(sizes)
    h = mixed(keys ^ U(0x5851F42D4C957F2D))
    spot = np.repeat(np.arange(n) * bins, sizes) + (((h >> U(32)) * U(bins)) >> U(32)).astype(np.int64)
    table = np.full(n * bins, 0xFFFFFFFF, np.uint32)
    np.minimum.at(table, spot, (h & U(0x7FFFFFFF)).astype(np.uint32))
    table = table.reshape(n, bins)
    have = table != 0xFFFFFFFF
    some = have.any(axis=1)
    row, col = np.nonzero(~have & some[:, None])
    attempt, full = 0, table.copy()
    while len(row) and attempt < 12:
        donor = (mixed(np.arange(bins, dtype=U) * U(0x2545F4914F6CDD1D) + U(attempt + 1)) % U(bins)).astype(np.int64)[col]
        hit = have[row, donor]
        full[row[hit], col[hit]] = table[row[hit], donor[hit]]
        row, col, attempt = row[~hit], col[~hit], attempt + 1
    if len(row):  # sets with few full bins: the first full one in a fixed random order for each bin
        order = mixed(np.arange(bins * bins, dtype=U) + U(0x51ED270B)).reshape(bins, bins)
        edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]]))
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
            there = np.flatnonzero(have[row[i]])
            full[row[i], col[i:j]] = table[row[i], there[order[np.ix_(col[i:j], there)].argmin(axis=1)]]
    return np.where(some[:, None], (full ^ (full >> 15)) & 0xFFFF, 0).astype(np.uint16)


def bands(sketches: np.ndarray, rows: int, count: int) -> np.ndarray:
    """48-bit band keys, one row per set."""
    parts = np.ascontiguousarray(sketches[:, : count * rows]).reshape(len(sketches), count, rows)
    key = np.zeros((len(sketches), count), U)
    for at in range(0, rows, 4):  # four places are one number
        four = np.zeros((len(sketches), count, 4), np.uint16)
        four[:, :, : min(4, rows - at)] = parts[:, :, at : at + 4]
        key = mixed(key + four.view("<u8")[:, :, 0])
    return mixed(key + np.arange(1, count + 1, dtype=U)) >> U(16)


#: Rows between batches and buckets: entries of a band's bucket, pairs of a batch, and what callers add from COPIES on.
SENT, ENTRIES, STAR, COPIES, CLASSES = "kind int, bucket int, data binary", 0, 1, 2, 3
PAIRS = "a_doc long, a_nr int, b_doc long, b_nr int"
FOUND = f"kind int, {PAIRS}"
A, B = ["a_doc", "a_nr"], ["b_doc", "b_nr"]
_PAIR = np.dtype([("a_doc", "<i8"), ("a_nr", "<i4"), ("b_doc", "<i8"), ("b_nr", "<i4")])


def packed_pairs(kind: int, a: np.ndarray, b: np.ndarray, doc: np.ndarray, nr: np.ndarray) -> dict:
    """A row of SENT with the pairs of elements number a and b."""
    out = np.empty(len(a), _PAIR)
    out["a_doc"], out["a_nr"], out["b_doc"], out["b_nr"] = doc[a], nr[a], doc[b], nr[b]
    return {"kind": kind, "bucket": int(out["a_doc"][0] & 0xFFFF) if len(a) else 0, "data": repeats.squeezed(out.tobytes())}


def banded(sets: Sets, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return bands(sketch(keys, sizes, sets.rows * sets.bands), sets.rows, sets.bands)


def stars(key: np.ndarray, doc: np.ndarray, nr: np.ndarray, tag: np.ndarray, bits: int) -> Iterator[dict]:
    """Rows of SENT for a batch of at most 65,536 elements with band keys key (a row each)."""
    order = np.lexsort((nr, doc))
    key, doc, nr, tag = key[order], doc[order], nr[order], tag[order]
    both = np.sort(((key << U(16)) | np.arange(len(doc), dtype=U)[:, None]).ravel())
    band, who = both >> U(16), (both & U(0xFFFF)).astype(np.int64)
    at = repeats._bounds(band)
    hub = np.repeat(who[at], np.diff(np.append(at, len(band))))
    ray = np.flatnonzero((hub != who) & (tag[hub] != tag[who]))
    if len(ray):
        pair = distinct((hub[ray] << 16 | who[ray]).astype(U)).astype(np.int64)
        yield packed_pairs(STAR, pair >> 16, pair & 0xFFFF, doc, nr)
    band, who = band[at], who[at]
    bucket = repeats.bucket_of(band >> U(48 - bits), bits)
    ends = np.append(repeats._bounds(bucket), len(band))
    for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
        w = who[i:j]
        yield {"kind": ENTRIES, "bucket": int(bucket[i]), "data": repeats.pack(band[i:j], doc[w], nr[w].astype(np.int64), tag[w])}


def requests(elements: DataFrame, sets: Sets, bits: int) -> DataFrame:
    """SENT of elements (doc, nr, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in pieces(frames, "text", chars=400_000):
            pdf = pdf.drop_duplicates("text")
            keys, sizes = sets.loose(pdf["text"].tolist())
            some = np.flatnonzero(sizes > 0)
            if not len(some):
                continue
            tag = np.add.reduceat(mixed(keys), (np.cumsum(sizes) - sizes)[some])
            held.append((banded(sets, keys, sizes[some]), pdf["doc"].to_numpy(np.int64)[some], pdf["nr"].to_numpy(np.int64)[some], tag))
            n += len(some)
            if n >= BATCH:
                yield pd.DataFrame(stars(*map(np.concatenate, zip(*held)), bits))
                held, n = [], 0
        if held:
            yield pd.DataFrame(stars(*map(np.concatenate, zip(*held)), bits))

    return elements.mapInPandas(run, SENT)


def _bucket_pairs(blobs: list[bytes]) -> pd.DataFrame | None:
    """Pairs of each band's least element and every other that is no copy of one before it."""
    key, doc, nr, tag = map(np.concatenate, zip(*map(repeats.unpack_tagged, blobs)))
    order = np.argsort(key)
    key = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    many = same[1:] | same[:-1]
    order, key = order[many], key[many]
    doc, nr, tag = doc[order], nr[order], tag[order]
    order = np.lexsort((nr, doc, tag, key))
    key, doc, nr, tag = key[order], doc[order], nr[order], tag[order]
    first = np.ones(len(key), bool)  # of copies, the least
    first[1:] = (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])
    key, doc, nr = key[first], doc[first], nr[first]
    order = np.lexsort((nr, doc, key))
    key, doc, nr = key[order], doc[order], nr[order]
    at = repeats._bounds(key)
    hub = np.repeat(at, np.diff(np.append(at, len(key))))
    ray = np.flatnonzero(hub != np.arange(len(key)))
    if not len(ray):
        return None
    return pd.DataFrame({"kind": STAR, "a_doc": doc[hub[ray]], "a_nr": nr[hub[ray]], "b_doc": doc[ray], "b_nr": nr[ray]}).drop_duplicates()


def met(sent: DataFrame, partitions: int, classes: Callable[[list[bytes]], pd.DataFrame | None] | None = None) -> DataFrame:
    """FOUND from rows of SENT: the pairs of the batches, and those that buckets find; classes does so for kind CLASSES."""

    def solved(kind: int, blobs: list[bytes]) -> pd.DataFrame | None:
        return _bucket_pairs(blobs) if kind == ENTRIES else classes(blobs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for pdf in frames:
            for kind, bucket, data in zip(pdf["kind"].tolist(), pdf["bucket"].tolist(), pdf["data"]):
                if now != (kind, bucket) and held:
                    if (out := solved(now[0], held)) is not None:
                        yield out
                    held = []
                now = (kind, bucket)
                if kind in (STAR, COPIES):
                    yield pd.DataFrame(np.frombuffer(repeats.unsqueezed(data), _PAIR)).assign(kind=kind)
                else:
                    held.append(data)
        if held and (out := solved(now[0], held)) is not None:
            yield out

    return sent.repartition(partitions, "bucket").sortWithinPartitions("kind", "bucket").mapInPandas(run, FOUND)


def buckets(entries: int) -> int:
    """Bits of a bucket's number for so many entries."""
    bits = 4
    while bits < repeats.MOST_BITS and entries / (1 << bits) > BUCKET:
        bits += 1
    return bits


def nodes_of(pairs: DataFrame) -> DataFrame:
    """(doc, nr): the distinct elements of pairs."""
    a, b = (pairs.select(F.col(x[0]).alias("doc"), F.col(x[1]).alias("nr")) for x in (A, B))
    return a.union(b).distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, sets: Sets) -> DataFrame:
    """The distinct pairs that the sets link. texts: (doc, nr, text).

    The texts of a hub's partners come to the hub; one with many partners is in several places.
    """
    parts = pairs.groupBy(*A).agg(F.ceil(F.count("*") / SALT).cast("int").alias("parts"))
    cut = pairs.join(parts, A).withColumn("salt", F.pmod(F.hash(*B), F.col("parts")))
    hubs = parts.select(*A, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("side"), F.col("a_doc").alias("doc"), F.col("a_nr").alias("nr"))
    wanted = hubs.union(cut.select(*A, "salt", F.lit(1), *B))
    rows = wanted.join(texts, ["doc", "nr"]).select(*A, "salt", "side", "doc", "nr", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, own = None, np.empty(0, U)
        for pdf in pieces(frames, "text", chars=1_000_000):
            keys, sizes = sets.keys(pdf["text"].tolist())
            edge = np.concatenate([[0], np.cumsum(sizes)])
            side, a_doc, a_nr = pdf["side"].to_numpy(), pdf["a_doc"].to_numpy(), pdf["a_nr"].to_numpy()
            hit = np.zeros(len(pdf), bool)
            for i in range(len(pdf)):
                mine = keys[edge[i] : edge[i + 1]]
                if side[i] == 0:
                    hub, own = (a_doc[i], a_nr[i]), mine
                elif hub == (a_doc[i], a_nr[i]):
                    hit[i] = _same(own, mine, sets)
            if hit.any():
                yield pd.DataFrame({"a_doc": a_doc[hit], "a_nr": a_nr[hit], "b_doc": pdf["doc"].to_numpy()[hit], "b_nr": pdf["nr"].to_numpy()[hit]})

    return rows.repartition(*A, "salt").sortWithinPartitions(*A, "salt", "side").mapInPandas(run, PAIRS)


def _same(a: np.ndarray, b: np.ndarray, sets: Sets) -> bool:
    """Whether two sorted sets are linked."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if not len(small) or 100 * len(small) < sets.percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return bool(sets.linked(int(np.count_nonzero(large[at] == small)), len(a), len(b)))


class _Union:
    def __init__(self) -> None:
        self.root: dict = {}

    def find(self, x):
        root = self.root
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    def join(self, a, b) -> bool:
        """Whether a and b hung apart."""
        a, b = self.find(a), self.find(b)
        self.root[b] = a
        return a != b


def cross_links(keys: np.ndarray, sizes: np.ndarray, asks: np.ndarray, label: np.ndarray, sets: Sets, within: bool = True) -> list[tuple[int, int]]:
    """Pairs (i, j) of linked sets with different labels, one of which asks (or, not within, just one), as many as join the labels.

    Two linked sets of a and b keys share a key among the first a - need(a) + 1 and b - need(b) + 1 in any common
    order, with need(n) the least intersection that a set of n keys has with a linked one; rare keys come first.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    often = times[which] > 1
    code = np.sort((owner << 40) | rank[which])  # sets in order, their rare keys first
    tok, edge = code & ((1 << 40) - 1), np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(len(code)) - edge[owner]
    need = -(-sets.percent * sizes // 100)
    shared = np.zeros(len(times), bool)
    shared[rank[which[often]]] = True
    first = np.flatnonzero((place <= (sizes - need)[owner]) & shared[tok])
    tok_, own_ = tok[first], owner[first]
    q = np.flatnonzero(asks[own_])
    order = np.argsort(tok_, kind="stable")
    by, who = tok_[order], own_[order]
    lo, hi = np.searchsorted(by, tok_[q]), np.searchsorted(by, tok_[q], "right")
    union, out, done = _Union(), [], np.empty(0, np.int64)
    step_at = 0
    total = np.cumsum(hi - lo)
    while step_at < len(q):
        step_to = max(int(np.searchsorted(total, (total[step_at - 1] if step_at else 0) + 1_000_000)), step_at + 1)
        n = (hi - lo)[step_at:step_to]
        at = np.repeat(lo[step_at:step_to] - np.cumsum(n) + n, n) + np.arange(n.sum())
        i, j = np.repeat(own_[q[step_at:step_to]], n), who[at]
        apart = label[i] != label[j]
        if not within:
            apart &= ~asks[j]
        i, j = i[apart], j[apart]
        fits = 100 * np.minimum(sizes[i], sizes[j]) >= sets.percent * np.maximum(sizes[i], sizes[j])
        i, j = i[fits], j[fits]
        pair = distinct(((np.minimum(i, j) << 32) | np.maximum(i, j)).astype(U)).astype(np.int64)
        for x, y in zip((pair >> 32).tolist(), (pair & 0xFFFFFFFF).tolist()):
            if union.find(label[x]) == union.find(label[y]):
                continue
            if _same(tok[edge[x] : edge[x + 1]], tok[edge[y] : edge[y + 1]], sets):
                union.join(label[x], label[y])
                out.append((x, y))
        step_at = step_to
    return out


def meetings(clusters: DataFrame, roots: DataFrame) -> DataFrame:
    """(cluster, block, part, asks, doc, nr, root): the elements of each pair of blocks of a cluster. clusters, roots: (doc, nr, root).

    Blocks from 0 on hold the elements outside the largest component, and those after them the others. A block of the
    former asks itself (block = part) and every later one, so every two elements meet once; a small cluster is one block.
    A cluster of n elements makes n rows for each of its blocks, about the power 1.5 of n.
    """
    e = ["doc", "nr"]
    label = clusters.select(*e, F.col("root").alias("cluster")).join(roots.select(*e, F.col("root").alias("own_root")), e, "left")
    label = label.select(*e, F.xxhash64("cluster").alias("cluster"), F.xxhash64(F.coalesce("own_root", F.struct("doc", "nr"))).alias("root"), F.pmod(F.xxhash64(*e), F.lit(SHARES)).cast("int").alias("share"))
    sizes = label.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("cluster").agg(F.max_by("root", "n").alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"), F.count("*").alias("roots"))
    open_ = open_.filter("roots > 1 and n > 2")  # a star of one ray is settled
    grown = F.greatest(F.lit(1.0), F.sqrt(F.col("n") / LARGE))
    outer, inner = F.ceil((F.col("n") - F.col("most")) / (BLOCK * grown)).cast("int"), F.ceil(F.col("most") / (OTHERS * grown)).cast("int")
    whole = F.col("n") <= OTHERS
    open_ = open_.select("cluster", "main", whole.alias("whole"), outer.alias("outer"), inner.alias("inner"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    live = label.join(open_, ["cluster", "share"]).withColumn("h", F.xxhash64(*e, F.lit(7))).withColumn("outside", F.col("root") != F.col("main"))
    own = F.when(F.col("whole"), 0).when(F.col("outside"), F.pmod("h", F.col("outer"))).otherwise(F.col("outer") + F.pmod("h", F.col("inner"))).cast("int")
    others = F.when(F.col("whole"), 1).when(F.col("outside"), F.col("outer") + F.col("inner")).otherwise(F.col("outer"))
    met_ = live.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), others - 1)).alias("other"))
    block = F.least("own", "other")
    asks = F.when(F.col("whole"), F.col("outside")).otherwise(F.col("own") == block)
    return met_.select("cluster", block.alias("block"), F.greatest("own", "other").alias("part"), asks.alias("asks"), *e, "root")


def across(clusters: DataFrame, roots: DataFrame, texts: DataFrame, sets: Sets) -> DataFrame:
    """Links between components of a cluster, as many as join them. clusters, roots: (doc, nr, root)."""
    place = ["cluster", "block", "part"]
    dealt = meetings(clusters, roots).join(texts, ["doc", "nr"]).select(*place, "asks", "doc", "nr", "root", "text")

    def compared(pdf: pd.DataFrame) -> pd.DataFrame | None:
        if not pdf["asks"].any() or pdf["root"].nunique() < 2:
            return None
        keys, sizes = map(np.concatenate, zip(*(sets.keys(x["text"].tolist()) for x in pieces(iter([pdf]), "text", 1_000_000))))
        found = cross_links(keys, sizes, pdf["asks"].to_numpy(), pdf["root"].to_numpy(), sets, pdf["block"].iat[0] == pdf["part"].iat[0])
        if not found:
            return None
        a, b = np.array(found).T
        doc, nr = pdf["doc"].to_numpy(), pdf["nr"].to_numpy()
        return pd.DataFrame({"a_doc": doc[a], "a_nr": nr[a], "b_doc": doc[b], "b_nr": nr[b]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in frames:
            key = pdf[place].to_numpy()
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
            for i, j in zip(edges[:-1], edges[1:]):
                if held and (held[-1][place].iloc[-1].to_numpy() != key[i]).any():
                    if (out := compared(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0])) is not None:
                        yield out
                    held = []
                held.append(pdf.iloc[i:j])
        if held and (out := compared(pd.concat(held, ignore_index=True))) is not None:
            yield out

    return dealt.repartition(*place).sortWithinPartitions(*place).mapInPandas(run, PAIRS)


def united(pairs: DataFrame) -> DataFrame:
    """(doc, nr, root) of the elements of pairs; root: (doc, nr) of the least that it hangs together with."""
    ends = [F.struct(F.col(x[0]).alias("doc"), F.col(x[1]).alias("nr")).alias(x[0][0]) for x in (A, B)]
    return components(pairs.select(*ends)).select("node.doc", "node.nr", "root")


def linked(star: DataFrame, sets: Sets, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """united() of the linked elements. star: the written, distinct candidate pairs; texts_of(nodes (doc, nr)): (doc, nr, text) of those."""
    done: list[str] = []
    texts = saved(texts_of(nodes_of(star)), "texts", into=done)
    links = saved(confirmed(star, texts, sets), "links", into=done)
    roots = saved(united(links), "roots", into=done)
    rest = saved(across(united(star), roots, texts, sets), "links", into=done)
    out = saved(united(links.union(rest)), "roots")
    dropped(star.sparkSession, done)
    return out

"""What the two exact deduplications share: finding, at the price of a fraction
of the text, the places whose windows may also start in another document.

A window is ``width`` consecutive symbols (words or bytes) of one document. Its
*anchor* is the least rolling hash of the ``gram`` symbol strings inside it, so
equal windows have equal anchors, and neighbouring windows mostly share theirs.
A *run* is a stretch of neighbouring windows with one anchor.

1. ``requests``: each batch of documents sends its anchors, sorted and packed,
   to buckets by hash; an anchor that several documents of the batch have is
   sent once. ``answers``: a bucket finds the anchors of two or more documents
   and names the runs that have them. All other text is settled: none of its
   windows occurs elsewhere.
2. ``candidates``: the documents so named, with their runs, as a written table.
3. ``verdicts``: their runs' fingerprints go to buckets by anchor. Runs with
   equal text are one class; all but its least document's are covered. The
   least document's runs are open if the anchor has other classes, else free.
4. ``settle``: the text of open runs is grouped by anchor in memory-sized
   groups, and the caller's kernel (suffix tree, suffix array) finds equal
   windows in a group. An anchor with very many classes is split further, by
   whole windows.

The least document that has a window keeps it: a window is removed where a
smaller document id has it too. Documents are told apart by id and text hash,
rows without an id take no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dropped, id_text, pieces, saved
from tessera.llm.hashing import even_keys, mixed, strings

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
#: Windows of a run at most; a longer one is several runs.
RUN = 2000
#: Characters of text for which one batch of anchors is sent.
BATCH_CHARS = 12_000_000
#: Anchors in a bucket, classes of runs that one kernel call takes, and classes of one anchor beyond which it is split by whole windows.
BUCKET, GROUP, HEAVY = 500_000, 100_000, 100_000
#: Partitions at most, each of which holds one bucket after another, and bits of a bucket's number at most.
PARTITIONS, MOST_BITS = 20_000, 20
#: Bytes of text of the whole anchor groups that one kernel call takes, unless one group alone has more.
GROUP_BYTES = 6_000_000
#: Bits of the filter on document ids: 4 MB at most.
FILTER_BITS = 25


@dataclass(frozen=True)
class Alphabet:
    """symbols: hashed symbols of a text (uint64). cut: the text of symbols i..j, as bytes. chunk: characters held at once."""

    symbols: Callable[[str], tuple[np.ndarray, object]]
    cut: Callable[[object, int, int], bytes]
    width: int
    gram: int
    chunk: int


def _power(n: int) -> np.uint64:
    return U(pow(int(BASE), n, 1 << 64))


def grams(sym: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all k consecutive symbols, by doubling."""
    out, have, h, size = None, 0, sym, 1
    while True:
        if k & size:
            if out is None:
                out = h
            else:
                m = len(sym) - have - size + 1
                out = out[:m] * _power(size) + h[have : have + m]
            have += size
        if have == k:
            return out
        h = h[:-size] * _power(size) + h[size:]
        size *= 2


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (w - size)], a[w - size :]) if size < w else a


def runs(sym: np.ndarray, doc: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(place of the first window, windows, anchor) of each run; doc tells which document a symbol is of."""
    n = len(sym) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U)
    least = sliding_min(mixed(grams(sym, gram)), width - gram + 1)
    inside = doc[:n] == doc[width - 1 :]
    first = inside.copy()
    first[1:] &= (least[1:] != least[:-1]) | (doc[1:n] != doc[: n - 1])
    at = np.flatnonzero(first)
    breaks = np.append(np.flatnonzero(first | ~inside), n)
    size = breaks[np.searchsorted(breaks, at, "right")] - at
    key = mixed(least[at] + BASE)  # least values are small ones; buckets go by even bits
    parts = -(-size // RUN)
    if len(parts) and parts.max() > 1:
        nr = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        rest = np.repeat(size, parts) - nr * RUN
        return np.repeat(at, parts) + nr * RUN, np.minimum(rest, RUN), np.repeat(key, parts)
    return at, size, key


def laid_out(alphabet: Alphabet, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Symbols of all texts in a row, the document of each, where each document begins, and what cut needs."""
    each = [alphabet.symbols(t) for t in texts]
    sizes = np.array([len(s) for s, _ in each], np.int64)
    sym = np.concatenate([s for s, _ in each]) if each else np.empty(0, U)
    return sym, np.repeat(np.arange(len(each), dtype=np.int32), sizes), np.cumsum(sizes) - sizes, [x for _, x in each]


def ordinals(doc_of_run: np.ndarray) -> np.ndarray:
    """0, 1, ... within each document."""
    i = np.arange(len(doc_of_run))
    new = np.ones(len(i), bool)
    new[1:] = doc_of_run[1:] != doc_of_run[:-1]
    return i - np.maximum.accumulate(np.where(new, i, 0))


# ---- packed anchors


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()


def _unplanes(b: memoryview, n: int, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(b, np.uint8, n * dtype.itemsize).reshape(dtype.itemsize, n).T).view(dtype).ravel()


def squeezed(body: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(body)


def unsqueezed(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def pack(key: np.ndarray, doc: np.ndarray, nr: np.ndarray, tag: np.ndarray | None = None) -> bytes:
    """Sorted 48-bit keys (as differences), document ids and numbers from -1 on; tag: a 64-bit number for each, if any."""
    ids, local = np.unique(doc, return_inverse=True)
    body = np.array([len(key), len(ids)], "<i8").tobytes()
    body += _planes(np.diff(key, prepend=U(0))) + _planes(np.diff(ids, prepend=np.int64(0))) + _planes(local.astype("<u4")) + _planes((nr + 1).astype("<u4"))
    return squeezed(body) if tag is None else squeezed(body + tag.astype("<u8").tobytes())


def _unpacked(blob: bytes) -> tuple[memoryview, int, np.ndarray, np.ndarray, np.ndarray]:
    body = memoryview(unsqueezed(blob))
    n, m = (int(x) for x in np.frombuffer(body, "<i8", 2))
    at = 16
    key = np.cumsum(_unplanes(body[at:], n, "<u8"))
    ids = np.cumsum(_unplanes(body[at + 8 * n :], m, "<i8"))
    local = _unplanes(body[at + 8 * n + 8 * m :], n, "<u4")
    nr = _unplanes(body[at + 12 * n + 8 * m :], n, "<u4").astype(np.int64) - 1
    return body[at + 16 * n + 8 * m :], n, key, ids[local], nr


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _unpacked(blob)[2:]


def unpack_tagged(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rest, n, *others = _unpacked(blob)
    return *others, np.frombuffer(rest, "<u8", n)


def _bounds(key: np.ndarray) -> np.ndarray:
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.flatnonzero(new)


def _by_document(doc: np.ndarray, nr: np.ndarray) -> tuple[list[int], list[list[int]]]:
    order = np.lexsort((nr, doc))
    doc, nr = doc[order], nr[order]
    at = _bounds(doc)
    return doc[at].tolist(), [x.tolist() for x in np.split(nr.astype(np.int32), at[1:])] if len(at) else []


def bucket_of(number: np.ndarray, bits: int) -> np.ndarray:
    """Keys of buckets by their number: where each has a partition, they are dealt one to each."""
    return even_keys(1 << bits)[number.astype(np.int64)] if 1 << bits <= PARTITIONS else number.astype(np.int64)


def requests(docs: DataFrame, alphabet: Alphabet, bits: int) -> DataFrame:
    """(bucket, data, doc_id, nrs): packed anchors, or runs that the batch itself knows to be shared."""
    schema = "bucket int, data binary, doc_id long, nrs array<int>"

    def sent(key: np.ndarray, doc: np.ndarray, nr: np.ndarray) -> Iterator[pd.DataFrame]:
        order = np.argsort(key, kind="stable")
        key, doc, nr = key[order], doc[order], nr[order]
        at = _bounds(key)
        several = np.repeat(np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at), np.diff(np.append(at, len(key))))
        d, n = _by_document(doc[several], nr[several])
        first = np.zeros(len(key), bool)
        first[at] = True
        go = ~several | first
        nr = np.where(several, -1, nr)[go]
        key, doc = key[go], doc[go]
        bucket = bucket_of(key >> U(48 - bits), bits)
        ends = np.append(_bounds(bucket), len(key))
        blobs = [pack(key[i:j], doc[i:j], nr[i:j]) for i, j in zip(ends[:-1], ends[1:])]
        yield pd.DataFrame({"bucket": bucket[ends[:-1]], "data": blobs, "doc_id": 0, "nrs": None})  # no null ids: pandas would make them floats
        if d:
            yield pd.DataFrame({"bucket": [hash(x) % (1 << bits) for x in d], "data": None, "doc_id": d, "nrs": n})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, chars = [], 0
        for pdf in pieces(frames, "text", alphabet.chunk):
            ids = pdf["doc_id"].to_numpy(np.int64)
            sym, doc, _, _ = laid_out(alphabet, pdf["text"].tolist())
            at, _, key = runs(sym, doc, alphabet.width, alphabet.gram)
            own = doc[at]
            if len(at):
                held.append((key >> U(16), ids[own], ordinals(own)))
            chars += int(pdf["text"].str.len().sum())
            if chars >= BATCH_CHARS and held:
                yield from sent(*map(np.concatenate, zip(*held)))
                held, chars = [], 0
        if held:
            yield from sent(*map(np.concatenate, zip(*held)))

    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    return rows.mapInPandas(run, schema)


def answers(asked: DataFrame, bits: int) -> DataFrame:
    """(doc_id, nr): the runs whose anchor another document may have."""

    def shared(blobs: list[bytes]) -> pd.DataFrame | None:
        parts = [unpack(b) for b in blobs]
        key, doc, nr = map(np.concatenate, zip(*parts))
        order = np.argsort(key, kind="stable")
        key, doc, nr = key[order], doc[order], nr[order]
        at = _bounds(key)
        size = np.diff(np.append(at, len(key)))
        many = (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)) | (np.minimum.reduceat(nr, at) < 0)
        take = np.repeat(many, size) & (nr >= 0)
        return pd.DataFrame({"doc_id": doc[take], "nr": nr[take]}) if take.any() else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, blobs = None, []
        for pdf in frames:
            known = pdf[pdf["data"].isna()]
            if len(known):
                yield pd.DataFrame({"doc_id": np.repeat(known["doc_id"].to_numpy(), known["nrs"].str.len()), "nr": np.concatenate(known["nrs"].tolist())})
            for b, data in zip(pdf["bucket"], pdf["data"]):
                if data is None:
                    continue
                if b != bucket and blobs:
                    if (out := shared(blobs)) is not None:
                        yield out
                    blobs = []
                bucket = b
                blobs.append(data)
        if blobs and (out := shared(blobs)) is not None:
            yield out

    return asked.repartition(min(1 << bits, PARTITIONS), "bucket").sortWithinPartitions("bucket").mapInPandas(run, "doc_id long, nr int")


def filtered(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows whose column may be in ids (column), by a bitmap of hashed values of a fixed size, sent to all executors.

    It spares the shuffle of rows that no join needs; what it lets through by chance, the join drops.
    """
    slot = F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))
    maps = ids.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("map"))
    marked = rows.withColumn("_slot", slot).withColumn("_bit", F.bitmap_bit_position("_slot"))
    marked = marked.join(F.broadcast(maps), F.bitmap_bucket_number("_slot") == maps["part"])
    byte = F.conv(F.hex(F.substring("map", F.expr("cast(_bit div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    return marked.filter(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).drop("part", "map", "_slot", "_bit")


def versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("version"), "text")


def candidates(rows: DataFrame, alphabet: Alphabet) -> DataFrame:
    """(doc_id, version, text, nrs) of the documents with runs to settle, as a written table."""
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(4, math.ceil(math.log2(max(1, total * 2 / (alphabet.width - alphabet.gram + 2) / BUCKET))))
    done: list[str] = []
    named = saved(answers(requests(rows, alphabet, min(bits, MOST_BITS)), min(bits, MOST_BITS)), "answers", into=done)
    by_doc = named.groupBy("doc_id").agg(F.collect_list("nr").alias("nrs"))
    # merge: what names documents grows with them, so it is never broadcast
    out = saved(filtered(rows, named).join(by_doc.hint("merge"), "doc_id").select("doc_id", "version", "text", "nrs"), "candidates")
    dropped(rows.sparkSession, done)
    return out


# ---- classes of runs


def prints(sym: np.ndarray, at: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent fingerprints of each run: of its windows' hashes (sums of them, and of them times their places), and a polynomial of its symbols.

    Sums over all runs come from running sums. The first has no algebraic structure; regular text that makes a
    polynomial vanish is told apart by it.
    """

    def running(a: np.ndarray) -> np.ndarray:
        out = np.empty(len(a) + 1, U)
        out[0] = 0
        np.cumsum(a, out=out[1:])
        return out

    if not len(at):
        return np.empty(0, U), np.empty(0, U)
    windows = strings(sym, width)
    ones, twos = running(windows), running(windows * np.arange(len(windows), dtype=U))
    one = ones[at + size] - ones[at]
    two = twos[at + size] - twos[at] - one * at.astype(U)
    power, back = np.full(len(sym), BASE), np.full(len(sym), U(pow(int(BASE), -1, 1 << 64)))
    power[0] = back[0] = 1
    sums = running(sym * np.cumprod(power))
    poly = (sums[at + size + (width - 1)] - sums[at]) * np.cumprod(back)[at]
    return mixed(one + size.astype(U)) ^ mixed(two), mixed(poly + size.astype(U))


def named_runs(alphabet: Alphabet, texts: list[str], named: list) -> tuple[np.ndarray, ...]:
    """(document, run number, first window, windows, anchor, two fingerprints) of the named runs of each text, and what cut needs."""
    sym, doc, begin, kept = laid_out(alphabet, texts)
    at, size, key = runs(sym, doc, alphabet.width, alphabet.gram)
    own = doc[at]
    edge = np.searchsorted(own, np.arange(len(texts) + 1))
    take = np.zeros(len(at), bool)
    for i, nrs in enumerate(named):
        nrs = np.asarray(nrs, np.int64) + edge[i]
        take[nrs[nrs < edge[i + 1]]] = True
    nr = (np.arange(len(at)) - edge[own])[take]
    at, size, key, own = at[take], size[take], key[take], own[take]
    fp, check = prints(sym, at, size, alphabet.width)
    return own, nr, at - begin[own], size, key, fp, check, kept


def spans_in(alphabet: Alphabet, texts: list[str], named: list) -> list[list[tuple[int, int]]]:
    """Spans of symbols of the named runs of each text."""
    own, _, start, size, *_ = named_runs(alphabet, texts, named)
    edge = np.searchsorted(own, np.arange(len(texts) + 1))
    both = list(zip(start.tolist(), (start + size + (alphabet.width - 1)).tolist()))
    return [both[i:j] for i, j in zip(edge[:-1], edge[1:])]


VERDICTS = "doc_id long, version long, covered array<int>, open array<int>"


def _verdict_rows(ids: np.ndarray, version: np.ndarray, nr: np.ndarray, is_open: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((nr, version, ids))
    ids, version, nr, is_open = ids[order], version[order], nr[order].astype(np.int32), is_open[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (version[1:] != version[:-1])
    at = np.flatnonzero(new)
    parts = list(zip(np.split(nr, at[1:]), np.split(is_open, at[1:]))) if len(at) else []
    return pd.DataFrame({"doc_id": ids[at], "version": version[at], "covered": [n[~o].tolist() for n, o in parts], "open": [n[o].tolist() for n, o in parts]})


def _new(key: np.ndarray, fp: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Where a class of equal runs begins."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])
    return new


def _classes(key: np.ndarray, fp: np.ndarray, check: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key, fp, check, id: the class' least id; whether the key has several classes."""
    new = _new(key, fp, check)
    head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    at = _bounds(key)
    several = np.repeat(np.add.reduceat(new, at, dtype=np.int64) > 1, np.diff(np.append(at, len(key)))) if len(at) else np.zeros(0, bool)
    return ids[head], several


_ENTRY = np.dtype([("key", "<u8"), ("fp", "<u8"), ("check", "<u8"), ("doc", "<u4"), ("nr", "<u4")])
#: Entries of runs that a batch gathers before it sends them.
ENTRIES = 300_000


def verdicts(near: DataFrame, alphabet: Alphabet, bits: int) -> DataFrame:
    """VERDICTS of the candidates' runs; a document is in several rows."""
    schema = f"bucket int, data binary, docs binary, {VERDICTS}"

    def sent(ids: np.ndarray, version: np.ndarray, nr: np.ndarray, key: np.ndarray, fp: np.ndarray, check: np.ndarray) -> Iterator[pd.DataFrame]:
        order = np.lexsort((ids, check, fp, key))
        ids, version, nr, key, fp, check = (x[order] for x in (ids, version, nr, key, fp, check))
        least, _ = _classes(key, fp, check, ids)
        go = ids == least
        known = _verdict_rows(ids[~go], version[~go], nr[~go], np.zeros(int((~go).sum()), bool))
        if len(known):
            yield known.assign(bucket=[hash(x) % (1 << bits) for x in known["doc_id"]], data=None, docs=None)
        entry = np.empty(int(go.sum()), _ENTRY)
        entry["key"], entry["fp"], entry["check"], entry["nr"] = key[go], fp[go], check[go], nr[go]
        ids, version = ids[go], version[go]
        bucket = bucket_of(entry["key"] >> U(64 - bits), bits)
        ends = np.append(_bounds(bucket), len(bucket))
        rows = []
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
            of = np.lexsort((version[i:j], ids[i:j]))
            d, v = ids[i:j][of], version[i:j][of]
            new = np.ones(j - i, bool)
            new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
            local = np.empty(j - i, np.int64)
            local[of] = np.cumsum(new) - 1
            entry["doc"][i:j] = local
            rows.append((int(bucket[i]), entry[i:j].tobytes(), np.stack([d[new], v[new]]).tobytes()))
        if rows:
            yield pd.DataFrame(rows, columns=["bucket", "data", "docs"]).assign(doc_id=0, version=0, covered=None, open=None)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in pieces(frames, "text", alphabet.chunk):
            ids, version = pdf["doc_id"].to_numpy(np.int64), pdf["version"].to_numpy(np.int64)
            own, nr, _, _, key, fp, check, _ = named_runs(alphabet, pdf["text"].tolist(), pdf["nrs"].tolist())
            if not len(own):
                continue
            held.append((ids[own], version[own], nr, key, fp, check))
            n += len(own)
            if n >= ENTRIES:
                yield from sent(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if held:
            yield from sent(*map(np.concatenate, zip(*held)))

    def judged(held: list[tuple[bytes, bytes]]) -> pd.DataFrame:
        parts, ids, version = [], [], []
        for data, docs in held:
            entry, table_ = np.frombuffer(data, _ENTRY), np.frombuffer(docs, np.int64).reshape(2, -1)
            parts.append(entry)
            ids.append(table_[0][entry["doc"]])
            version.append(table_[1][entry["doc"]])
        entry, ids, version = np.concatenate(parts), np.concatenate(ids), np.concatenate(version)
        order = np.lexsort((ids, entry["check"], entry["fp"], entry["key"]))
        entry, ids, version = entry[order], ids[order], version[order]
        least, several = _classes(entry["key"], entry["fp"], entry["check"], ids)
        take = (ids > least) | several
        return _verdict_rows(ids[take], version[take], entry["nr"][take].astype(np.int64), (ids == least)[take])

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, held = None, []
        for pdf in frames:
            known = pdf[pdf["data"].isna()]
            if len(known):
                yield known[["doc_id", "version", "covered", "open"]]
            for b, data, docs in zip(pdf["bucket"], pdf["data"], pdf["docs"]):
                if data is None:
                    continue
                if b != bucket and held:
                    if len(out := judged(held)):
                        yield out
                    held = []
                bucket = b
                held.append((data, docs))
        if held and len(out := judged(held)):
            yield out

    return near.mapInPandas(ask, schema).repartition(min(1 << bits, PARTITIONS), "bucket").sortWithinPartitions("bucket").mapInPandas(answer, VERDICTS)


PIECES = "key long, fp long, check long, doc_id long, version long, start int, n int, piece binary"


def run_pieces(docs: DataFrame, alphabet: Alphabet) -> DataFrame:
    """Rows of PIECES for the open runs of docs (doc_id, version, text, open)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(frames, "text", alphabet.chunk):
            ids, version = pdf["doc_id"].to_numpy(np.int64), pdf["version"].to_numpy(np.int64)
            own, _, start, size, key, fp, check, kept = named_runs(alphabet, pdf["text"].tolist(), pdf["open"].tolist())
            for lo in range(0, len(own), 20_000):
                o, s, n, k, f, c = (x[lo : lo + 20_000] for x in (own, start, size, key, fp, check))
                data = [alphabet.cut(kept[d], a, a + m + alphabet.width - 1) for d, a, m in zip(o, s, n)]
                yield pd.DataFrame({"key": k.view(np.int64), "fp": f.view(np.int64), "check": c.view(np.int64), "doc_id": ids[o], "version": version[o], "start": s, "n": n, "piece": data})

    return docs.mapInPandas(run, PIECES)


def covered_windows(group: pd.DataFrame, equal: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]], width: int) -> Iterator[pd.DataFrame]:
    """Covered spans of whole anchor groups. equal: for pieces, the piece and place of each window and its class."""
    group = group.sort_values(["key", "fp", "check", "doc_id"], kind="stable", ignore_index=True)
    key, doc = group["key"].to_numpy(), group["doc_id"].to_numpy()
    new = _new(key, group["fp"].to_numpy(), group["check"].to_numpy())
    head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    start, n, version = (group[c].to_numpy() for c in ("start", "n", "version"))
    over = doc > doc[head]
    if over.any():
        yield pd.DataFrame({"doc_id": doc[over], "version": version[over], "start": start[over], "stop": (start + n)[over] + (width - 1)})
    # anchors with several classes: the windows of each class' first row are compared
    first = np.flatnonzero(new)
    anchors = key[first]
    alone = np.ones(len(first), bool)
    alone[1:] &= anchors[1:] != anchors[:-1]
    alone[:-1] &= anchors[1:] != anchors[:-1]
    first = first[~alone]
    if not len(first):
        return
    piece, place, label = equal([group["piece"].iat[i] for i in first])
    if not len(label):
        return
    owner = doc[first][piece]
    order = np.argsort(label, kind="stable")
    at = _bounds(label[order])
    least = np.empty(len(label), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(owner[order], at), np.diff(np.append(at, len(label))))
    hit = owner > least
    by_class = np.full(len(key), -1)
    by_class[first] = np.arange(len(first))
    by_class = by_class[head]
    # every row of the class' least document has those spans
    spans = spans_of(piece[hit], place[hit])
    if not len(spans):
        return
    rows = np.flatnonzero((by_class >= 0) & ~over)
    table = pd.DataFrame({"c": by_class[rows], "doc_id": doc[rows], "version": version[rows], "at": start[rows]}).merge(spans, on="c")
    yield pd.DataFrame({"doc_id": table["doc_id"], "version": table["version"], "start": table["at"] + table["a"], "stop": table["at"] + table["b"] + width})


def spans_of(piece: np.ndarray, place: np.ndarray) -> pd.DataFrame:
    """(c, a, b): stretches a..b of neighbouring places of a piece."""
    order = np.lexsort((place, piece))
    piece, place = piece[order], place[order]
    new = np.ones(len(piece), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(piece)) - 1
    return pd.DataFrame({"c": piece[at], "a": place[at], "b": place[last]}) if len(at) else pd.DataFrame({"c": [], "a": [], "b": []}, dtype=np.int64)


SPANS = "doc_id long, version long, start int, stop int"


def settle(live: DataFrame, equal, windows_of, width: int, group_rows: int = GROUP) -> DataFrame:
    """(doc_id, version, start, stop) of all covered spans of open runs, from the written rows of run_pieces.

    windows_of(piece): the bytes of each window of a piece, for anchors with more than HEAVY classes; those
    are split by whole windows, each of which needs only its least document.
    """
    heavy = saved(live.groupBy("key").count().filter(F.col("count") > min(group_rows, HEAVY)).select("key"), "heavy")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in frames:
            for pdf in pieces(iter([batch]), "piece", GROUP_BYTES // 4, group_rows):
                held.append(pdf)
                size += int(pdf["piece"].str.len().sum())
                if size >= GROUP_BYTES or sum(map(len, held)) >= group_rows:
                    whole = pd.concat(held, ignore_index=True)
                    cut = int(np.searchsorted(whole["key"].to_numpy(), whole["key"].iat[-1]))  # the last anchor may go on
                    if cut:
                        yield from covered_windows(whole.iloc[:cut], equal, width)
                    held = [whole.iloc[cut:]]
                    size = int(held[0]["piece"].str.len().sum())
        if held:
            yield from covered_windows(pd.concat(held, ignore_index=True), equal, width)

    light = live
    split = None
    if heavy.limit(1).count():
        light = live.join(heavy, "key", "left_anti").select(*live.columns)

        def explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for lo in range(0, len(pdf), 500):
                    part = pdf.iloc[lo : lo + 500]
                    wins = [windows_of(p) for p in part["piece"]]
                    sizes = [len(w) for w in wins]
                    yield pd.DataFrame({
                        "window": [w for ws in wins for w in ws], "doc_id": np.repeat(part["doc_id"].to_numpy(), sizes), "version": np.repeat(part["version"].to_numpy(), sizes),
                        "start": np.repeat(part["start"].to_numpy(), sizes) + np.concatenate([np.arange(s) for s in sizes]),
                    })

        each = live.join(heavy, "key", "left_semi").select(*live.columns).mapInPandas(explode, "window binary, doc_id long, version long, start int")
        each = each.withColumn("h1", F.xxhash64("window")).withColumn("h2", F.xxhash64("window", F.lit(1))).drop("window")
        least = each.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
        split = each.join(least, ["h1", "h2"]).filter("doc_id > least").select("doc_id", "version", "start", (F.col("start") + width).alias("stop"))
    spans = light.repartition("key").sortWithinPartitions("key").mapInPandas(run, SPANS)
    return spans.union(split) if split is not None else spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal spans of a document, sorted."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def covered(rows: DataFrame, alphabet: Alphabet, equal, windows_of, group_rows: int = GROUP) -> DataFrame:
    """(doc_id, version, text, covered, spans) of the documents with covered text: numbers of runs, and further spans of symbols."""
    key = ["doc_id", "version"]
    near = candidates(rows, alphabet)
    n = near.agg(F.sum(F.size("nrs"))).first()[0] or 0
    judged = verdicts(near, alphabet, min(MOST_BITS, max(4, math.ceil(math.log2(max(1, n / (4 * BUCKET)))))))
    judged = saved(judged.groupBy(*key).agg(F.flatten(F.collect_list("covered")).alias("covered"), F.flatten(F.collect_list("open")).alias("open")), "verdicts")
    is_open = judged.filter(F.size("open") > 0).select(*key, "open")
    unsettled = filtered(near, is_open).join(is_open.hint("merge"), key).select(*key, "text", "open")
    spans = settle(saved(run_pieces(unsettled, alphabet), "pieces"), equal, windows_of, alphabet.width, group_rows)
    by_doc = spans.groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    found = judged.select(*key, "covered").join(by_doc, key, "left").filter((F.size("covered") > 0) | F.col("spans").isNotNull())
    return near.select(*key, "text").dropDuplicates(key).join(found.hint("merge"), key).select(*key, "text", "covered", "spans")


def removed(alphabet: Alphabet, pdf: pd.DataFrame) -> list[list[tuple[int, int]]]:
    """Maximal removed spans of each row of a frame of covered()."""
    whole = spans_in(alphabet, pdf["text"].tolist(), pdf["covered"].tolist())
    return [merged([*a, *((x["start"], x["stop"]) for x in (b if b is not None else ()))]) for a, b in zip(whole, pdf["spans"])]

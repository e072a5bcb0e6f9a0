"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

1. Labelled documents are split into folds. Counts of character strings of five
   are summed over all trusted documents of the training folds, for each
   language (and all together); a caller may set a bound, ``training``, and gets
   the first ones by a hash of their ids. Lower orders count in how many contexts
   a string occurs.
2. Discounts (one each for counts 1, 2 and more) follow from counts of counts by
   language and order. Sharded joins of the counts with their contexts' sums and
   with the next lower order give every string's interpolated probability and
   every context's weight for what it has not seen.
3. Perplexity is a join of sharded counts: documents are dealt to blocks, each
   block sends its distinct strings to the shards, where they meet the model's
   strings and contexts, and gets their log probabilities back. A string and the
   strings and contexts it falls back to are in one shard, by the two characters
   before the last. The model stays in its shards at any size.
4. The rejected and toxic labelled documents give models of the same kind. A
   document's contrast is the greatest log ratio of the two models over any
   stretch of characters, so that a few words tell in a long text.
5. Labelled documents kept out of the counts give the edges of each language:
   those of perplexity and of contrast that make the fewest mistakes on them,
   halfway to the next document. Edges of perplexity are never wider than
   extreme quantiles of the trusted and a margin, which alone decide where no
   rejected document is seen. Rejected are texts unlike the trusted (symbols,
   shouting, tables, one word again and again), and those with a passage like
   the rejected or toxic.

Characters up to U+0BFF have codes of their own, others share 1022 codes by a
hash, so a string of five tells them apart. The model covers whole texts.

Edge cases: a null or empty text has no perplexity and is rejected; a document
without a language, or of one with fewer than MIN_TRUSTED trusted documents, is
judged by the model and the quantiles of all languages; without any trusted
document every text passes; labels repeat or are null: a document is trusted if
one of its labels says quality 1 and toxic 0 and none says otherwise, and
rejected if one says quality 0 or toxic 1. A language with fewer than
MIN_TRUSTED rejected documents is contrasted with those of all languages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import repeats
from tessera.llm.common import dropped, pieces, saved
from tessera.llm.hashing import distinct, even_keys, mixed

ORDER, BITS = 5, 12
SYMBOLS = 1 << BITS
#: The name of the model of all languages.
ALL = "*"
#: Before the name of a model of rejected documents.
AGAINST = "\x01"
#: Characters with a code of their own.
OWN_CODES = 0xC00
#: Labelled documents that the model is trained on at most: no bound.
TRAINING: int | None = None
#: Bytes of text in a block, shards at most, and rows that a task packs at once.
BLOCK_BYTES, SHARDS, PACKED = 48_000_000, 256, 400_000
#: Bytes of documents that a task deals to blocks at once.
DEALT = 32_000_000
#: Blocks up to which each has a partition of its own; more even out by themselves.
EVEN = 512
#: Trusted documents a language needs for a model of its own; one in FOLDS of them is kept for the quantiles.
MIN_TRUSTED, FOLDS = 50, 5
#: Cells of the edges: so many to a unit of log perplexity, and of contrast.
CELLS = 1000, 20
#: So many kept rejected documents weigh as much as a lost trusted one. No edge is nearer than SPREAD standard deviations
#: of the trusted, more where they are few. Held-out trusted documents that a language's own edge of contrast needs.
LOST, SPREAD, FEW, LEAST_HELD = 3, 2.25, 10, 8


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(strings of ORDER symbols that end at each character, as numbers; characters of each text)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    far = np.flatnonzero(codes >= OWN_CODES)
    codes[far] = OWN_CODES + (mixed(codes[far].astype(np.uint64)) % np.uint64(SYMBOLS - 2 - OWN_CODES)).astype(np.int64)
    codes += 1
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    gram = codes.copy()
    for i in range(1, ORDER):
        gram[i:] += np.where(place[i:] >= i, codes[: max(len(codes) - i, 0)], 0) << (BITS * i)
    return gram, sizes


#: Parts in which the counts of a model are summed.
COUNTED = 32


def counts(trusted: DataFrame, into: list[str] | None = None) -> DataFrame:
    """(lang, g, c): how often each string of ORDER symbols occurs; trusted: (lang, text), a lang of rejected texts with AGAINST before it.

    Tasks send their strings and counts packed, by part of a language's strings.
    """

    def summed(g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(g)
        g, c = g[order], c[order]
        at = repeats._bounds(g)
        return g[at], np.add.reduceat(c, at) if len(at) else c

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in pieces(frames, "text", 1_000_000):
            for lang, part in pdf.groupby("lang"):
                g = np.sort(symbols(part["text"].tolist())[0])
                at = repeats._bounds(g)
                g, c = g[at], np.diff(np.append(at, len(g)))
                sums[lang] = summed(np.concatenate([sums[lang][0], g]), np.concatenate([sums[lang][1], c])) if lang in sums else (g, c)
        for lang, (g, c) in sums.items():
            part = (mixed(g.astype(np.uint64)) % np.uint64(COUNTED)).astype(np.int64)
            rows = [(lang, i, _pack(g[k]), repeats.squeezed(repeats._planes(c[k].astype("<i8")))) for i, k in _split(g, part)]
            yield pd.DataFrame(rows, columns=["lang", "part", "data", "times"])

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, entries = None, [], 0

        def out() -> Iterator[pd.DataFrame]:
            if held:
                g, c = summed(*map(np.concatenate, zip(*held)))
                for i in range(0, len(g), 50_000):
                    yield pd.DataFrame({"lang": now[0], "g": g[i : i + 50_000], "c": c[i : i + 50_000]})

        for pdf in frames:
            for lang, part, data, times in pdf.itertuples(index=False):
                if (lang, part) != now:
                    yield from out()
                    now, held, entries = (lang, part), [], 0
                body = repeats.unsqueezed(times)
                held.append((_unpack(data), repeats._unplanes(body, len(body) // 8, "<i8")))
                entries += len(held[-1][0])
                if entries > max(2_000_000, 2 * len(held[0][0])):
                    held = [summed(*map(np.concatenate, zip(*held)))]
                    entries = len(held[0][0])
        yield from out()

    sent = trusted.mapInPandas(run, "lang string, part int, data binary, times binary")
    own = sent.repartition("lang", "part").sortWithinPartitions("lang", "part").mapInPandas(merge, "lang string, g long, c long")
    own = saved(own, "counts", into=into)
    all_ = F.when(F.col("lang").startswith(AGAINST), F.lit(AGAINST + ALL)).otherwise(F.lit(ALL))
    every = own.filter(F.col("lang") != all_).union(own.groupBy(all_.alias("lang"), "g").agg(F.sum("c").alias("c")))
    return saved(every, "counts", into=into)


def _low(column: str, symbols_: int):
    return F.col(column).bitwiseAND(F.lit((1 << (BITS * symbols_)) - 1))


def model(count: DataFrame) -> DataFrame:
    """(lang, n, back, g, value): log probability of string g of n symbols, or (back) log weight of context g of n - 1."""
    done: list[str] = []
    levels = {ORDER: count}
    for n in range(ORDER - 1, 0, -1):
        levels[n] = saved(levels[n + 1].groupBy("lang", _low("g", n).alias("g")).agg(F.count("*").alias("c")), "strings", into=done)
    out, lower = None, None
    for n in range(1, ORDER + 1):
        c = levels[n]
        of = [F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.expr("n1 / (n1 + 2 * n2)")  # of no strings seen once or twice no discount follows; then one half is taken

        def discount(i: int):
            return F.least(F.greatest(F.coalesce(F.lit(i) - (i + 1) * F.try_divide(y * F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.5)), F.lit(0.05)), F.lit(i - 0.05))

        d = c.groupBy("lang").agg(*of).withColumn("n1", F.greatest("n1", F.lit(1e-9)))
        d = d.select("lang", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)])
        c = c.join(F.broadcast(d), "lang")  # a row for each language
        own = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        c = c.select("lang", "g", F.shiftright("g", BITS).alias("h"), "c", own.alias("d"))
        context = c.groupBy("lang", "h").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("rest"))
        p = c.join(context, ["lang", "h"])
        if lower is None:
            p = p.withColumn("below", F.lit(1.0 / SYMBOLS))
        else:
            p = p.withColumn("low", _low("g", n - 1)).join(lower, ["lang", "low"])
        p = saved(p.select("lang", "g", ((F.col("c") - F.col("d")) / F.col("total") + F.col("rest") * F.col("below")).alias("p")), "level", into=done)
        lower = p.select("lang", F.col("g").alias("low"), F.col("p").alias("below"))
        rows = p.select("lang", F.lit(n).alias("n"), F.lit(False).alias("back"), "g", F.ln("p").alias("value"))
        rows = rows.union(context.select("lang", F.lit(n), F.lit(True), "h", F.ln("rest")))
        out = rows if out is None else out.union(rows)
    out = saved(out, "model")
    dropped(out.sparkSession, done)
    return out


Table = dict[tuple[str, int, bool], tuple[np.ndarray, np.ndarray]]


def _find(table: tuple[np.ndarray, np.ndarray] | None, g: np.ndarray) -> np.ndarray:
    if table is None or not len(table[0]):
        return np.full(len(g), np.nan)
    at = np.minimum(np.searchsorted(table[0], g), len(table[0]) - 1)
    return np.where(table[0][at] == g, table[1][at], np.nan)


def log_probabilities(table: Table, lang: str, grams: np.ndarray) -> np.ndarray:
    """Of distinct strings of ORDER symbols: the last symbol's log probability after the others."""
    out, weight = np.full(len(grams), np.nan), np.zeros(len(grams))
    for n in range(ORDER, 0, -1):
        todo = np.flatnonzero(np.isnan(out))
        g = grams[todo] & ((1 << (BITS * n)) - 1)
        p = _find(table.get((lang, n, False)), g)
        hit = ~np.isnan(p)
        out[todo[hit]] = weight[todo[hit]] + p[hit]
        back = _find(table.get((lang, n, True)), g >> BITS)
        weight[todo] += np.where(np.isnan(back), 0.0, back)
    todo = np.isnan(out)
    out[todo] = weight[todo] - np.log(SYMBOLS)
    return out


def _stretches(score: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The greatest sum of scores on end in each document; 0 where none is above 0."""
    if not len(sizes):
        return np.zeros(0)
    ends, edge = np.concatenate([[0.0], np.cumsum(score)]), np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    upto = ends[np.arange(len(owner)) - owner]  # a document's sums, with the one before its first score
    apart = ends.max() - ends.min() + 1  # each document's sums lie below those of all before
    upto = upto - apart * owner
    return np.maximum.reduceat(upto - np.minimum.accumulate(upto), edge[:-1] + np.arange(len(sizes)))


def _per_document(pdf: pd.DataFrame, value: Callable[[str, str, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray | list[float | None]]:
    """n_chars, perplexity and contrast of each text. value(lang, against, strings): log probabilities of distinct strings in both models."""
    texts = [t or "" for t in pdf["text"]]
    total, chars, contrast = np.zeros(len(texts)), np.array([len(t) for t in texts], np.int64), np.zeros(len(texts))
    names = np.array(list(zip(pdf["lang"], pdf["against"])), dtype=object).reshape(-1, 2)
    for lang, against in set(map(tuple, names)):
        rows = np.flatnonzero((names[:, 0] == lang) & (names[:, 1] == against))
        grams, sizes = symbols([texts[i] for i in rows])
        if not len(grams):
            continue
        g = distinct(grams)
        where = np.searchsorted(g, grams)
        own, other = value(lang, against, g)
        ends = np.concatenate([[0], np.cumsum(own[where])])
        edge = np.concatenate([[0], np.cumsum(sizes)])
        total[rows] = ends[edge[1:]] - ends[edge[:-1]]
        contrast[rows] = _stretches((other - own)[where], sizes)
    return {"n_chars": chars, "perplexity": _perplexity(total, chars), "contrast": contrast}


def _perplexity(total: np.ndarray, chars: np.ndarray) -> list[float | None]:
    return [float(np.exp(-t / n)) if n else None for t, n in zip(total, chars)]


def _shard_of(pair: np.ndarray, shards: int) -> np.ndarray:
    """The shard of strings whose two characters before the last are pair."""
    return even_keys(shards)[(mixed(pair.astype(np.uint64) & np.uint64((1 << (2 * BITS)) - 1)) % np.uint64(shards)).astype(np.int64)]


def _pack(g: np.ndarray) -> bytes:
    """Sorted numbers, as differences."""
    return repeats.squeezed(repeats._planes(np.diff(g, prepend=np.int64(0))))


def _unpack(blob: bytes) -> np.ndarray:
    body = repeats.unsqueezed(blob)
    return np.cumsum(repeats._unplanes(body, len(body) // 8, "<i8"))


#: Rows of the shards: of the model (n > 0; back: weights of contexts) and, with n 0, of a block that asks for strings.
SHARD = "shard int, n int, back boolean, block int, lang string, against string, data binary, value binary"


def _split(g: np.ndarray, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, numbers of g in it) of sorted g."""
    order = np.argsort(shard, kind="stable")
    at = np.append(repeats._bounds(shard[order]), len(g))
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        yield int(shard[order[i]]), order[i:j]


def shards_of(trained: DataFrame, shards: int) -> DataFrame:
    """The model as rows of SHARD. Strings of one and two characters, which a long string of any shard may fall back to, are in all; there are at most SYMBOLS^2."""

    def sent(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = []
        for (lang, n, back), part in pdf.groupby(["lang", "n", "back"]):
            part = part.sort_values("g")
            g, value = part["g"].to_numpy(np.int64), part["value"].to_numpy(np.float64)
            if n <= 2:
                parts = [(i, np.arange(len(g))) for i in even_keys(shards).tolist()]
            else:
                parts = _split(g, _shard_of(g if back else g >> BITS, shards))
            rows += [(i, n, back, -1, lang, "", _pack(g[k]), value[k].tobytes()) for i, k in parts]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SHARD.split(", ")])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in frames:
            held.append(pdf)
            if sum(map(len, held)) >= PACKED:
                yield from sent(pd.concat(held))
                held = []
        if held:
            yield from sent(pd.concat(held))

    return trained.select("lang", "n", "back", "g", "value").mapInPandas(run, SHARD)


def _packed(docs: DataFrame) -> DataFrame:
    """(block, data): the rows of docs (block, ..) that a task has of a block, together and compressed, as texts compress poorly one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def sent() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).sort_by("block").combine_chunks()
            block = rows["block"].to_numpy()
            ends = [*repeats._bounds(block).tolist(), len(block)]
            for i, j in zip(ends[:-1], ends[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_table(rows.slice(i, j - i))
                data = pa.array([repeats.squeezed(sink.getvalue().to_pybytes())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([int(block[i])], pa.int32()), data], ["block", "data"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.nbytes for x in held) >= DEALT:
                yield from sent()
                held = []
        if held:
            yield from sent()

    return docs.mapInArrow(run, "block int, data binary")


def _rows(blobs: list[bytes]) -> Iterator[pd.DataFrame]:
    for blob in blobs:
        yield pa.ipc.open_stream(repeats.unsqueezed(blob)).read_pandas()


def asks(dealt: DataFrame, shards: int) -> DataFrame:
    """Rows of SHARD: the distinct strings of each block, by its models. dealt: _packed (block, lang, against, text), whole blocks in a partition."""

    def sent(block: int, lang: str, against: str, g: np.ndarray) -> pd.DataFrame:
        rows = [(i, 0, False, block, lang, against, _pack(g[k]), b"") for i, k in _split(g, _shard_of(g >> BITS, shards))]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SHARD.split(", ")])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for pdf in pieces((x for f in frames for x in _rows(f["data"])), "text", 500_000):
            for key, part in pdf.groupby(["block", "lang", "against"]):
                g = distinct(symbols([t or "" for t in part["text"]])[0])
                if not len(g):
                    continue
                many, fresh = held.setdefault(key, [np.empty(0, np.int64), []])
                fresh.append(g)
                if sum(map(len, fresh)) > max(1_000_000, len(many) // 2):
                    held[key] = [distinct(np.concatenate([many, *fresh])), []]
        for key, (many, fresh) in held.items():
            yield sent(*key, distinct(np.concatenate([many, *fresh])))

    return dealt.mapInPandas(run, SHARD)


def replies(rows: DataFrame, partitions: int) -> DataFrame:
    """(block, lang, against, data, own, other): log probabilities of the strings that blocks ask for, from rows of SHARD."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts, table = None, {}, None
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if r.shard != now:
                    now, parts, table = r.shard, {}, None
                if r.n:
                    parts.setdefault((r.lang, r.n, r.back), []).append((_unpack(r.data), np.frombuffer(r.value, np.float64)))
                    continue
                if table is None:
                    table = {}
                    for key, found in parts.items():
                        g, value = map(np.concatenate, zip(*found))
                        order = np.argsort(g)
                        table[key] = (g[order], value[order])
                    parts = {}
                g = _unpack(r.data)
                own, other = (log_probabilities(table, m, g).astype(np.float32).tobytes() for m in (r.lang, r.against))
                out.append((r.block, r.lang, r.against, r.data, own, other))
            if out:
                yield pd.DataFrame(out, columns=["block", "lang", "against", "data", "own", "other"])

    dealt = rows.repartition(partitions, "shard").sortWithinPartitions("shard", F.col("n") == 0)
    return dealt.mapInPandas(run, "block int, lang string, against string, data binary, own binary, other binary")


def scored(docs: DataFrame, trained: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, version, lang, against, text) without text, with n_chars, perplexity and contrast; lang, against: models.

    The texts are dealt to their blocks once, packed; both readings of a block share that exchange.
    """
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = int(total // block_bytes) + 1
    shards = min(max(blocks, 8), SHARDS)
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"]
    sent = docs.withColumn("no_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("long")))
    block = F.pmod(F.xxhash64("doc_id", "version"), F.lit(blocks)).cast("int")
    if blocks <= EVEN:  # a partition for each block
        block = F.element_at(F.array(*[F.lit(int(k)) for k in even_keys(blocks)]), block + 1)
    dealt = _packed(sent.withColumn("block", block)).repartition(blocks, "block")
    back = replies(shards_of(trained, shards).union(asks(dealt, shards)), shards)
    schema = ", ".join([*kept, "no_id boolean", "n_chars long", "perplexity double", "contrast double"])
    names = [c.split()[0] for c in schema.split(", ")]

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tables = {}
        for key, part in right.groupby(["lang", "against"]):
            g = np.concatenate([_unpack(x) for x in part["data"]])
            order = np.argsort(g)
            tables[key] = (g[order], *(np.frombuffer(b"".join(part[c]), np.float32)[order] for c in ("own", "other")))

        def value(lang: str, against: str, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            known, own, other = tables[lang, against]
            at = np.searchsorted(known, g)
            return own[at].astype(np.float64), other[at].astype(np.float64)

        parts = [pdf.drop(columns=["text", "block"]).assign(**_per_document(pdf, value)) for pdf in pieces(_rows(left["data"]), "text", 500_000)]
        return pd.concat(parts)[names] if parts else pd.DataFrame({c: [] for c in names})

    made = dealt.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(answer, schema)
    return made.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def _halfway(cell: np.ndarray, bad: np.ndarray, at: int, step: int) -> float | None:
    """The middle between cell number at and the next cell in that direction, if any there holds rejected documents."""
    beyond = bad[at + 1 :] if step > 0 else bad[:at]
    return (cell[at] + cell[at + step] + 1) / 2 if beyond.any() else None


def edges(held: DataFrame, low: float, high: float, margin: float) -> DataFrame:
    """(lang, least, most, far) of each language and (lang null) of all: edges of perplexity and of contrast.

    held: (lang, perplexity, contrast, good). Tasks get counts by cells of a fixed width, so a frequent language is no large task.
    """
    ln = F.floor(F.ln("perplexity") * CELLS[0])
    by = [F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")]
    two = held.select("lang", "good", F.explode(F.array(F.struct(F.lit(0).alias("kind"), ln.alias("cell")), F.struct(F.lit(1).alias("kind"), F.floor(F.col("contrast") * CELLS[1]).alias("cell")))).alias("x"))
    own = two.groupBy("lang", "x.kind", "x.cell").agg(*by)
    cells = own.union(own.groupBy("kind", "cell").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).select(F.lit(None).cast("string").alias("lang"), "kind", "cell", "good", "bad"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        least, most, far = 0.0, np.inf, None if pdf["lang"].iat[0] else np.inf
        for kind, part in pdf.sort_values("cell").groupby("kind"):
            cell, good, bad = (part[c].to_numpy(np.int64) for c in ("cell", "good", "bad"))
            if not good.any():
                continue
            share, mean = np.cumsum(good) / good.sum(), np.average(cell, weights=good)
            apart = SPREAD * (1 + FEW / good.sum()) * np.sqrt(np.average((cell - mean) ** 2, weights=good))  # of few documents the last one is no edge
            if kind == 0:
                i, j = (int(np.searchsorted(share, x)) for x in (low, high))
                least, most = np.exp(cell[i] / CELLS[0]) * (1 - margin), np.exp((cell[j] + 1) / CELLS[0]) * (1 + margin)
                under, over = _halfway(cell, bad, i, -1), _halfway(cell, bad, j, 1)
                least = least if under is None else max(least, np.exp(min(under, mean - apart) / CELLS[0]))
                most = most if over is None else min(most, np.exp(max(over, mean + apart) / CELLS[0]))
            elif pdf["lang"].iat[0] is None or good.sum() >= LEAST_HELD:
                over = _halfway(cell, bad, int(np.cumsum(LOST * good - bad).argmax()), 1)
                middle = cell[np.searchsorted(share, 0.5)]
                far_off = np.abs(cell - middle)
                order = np.argsort(far_off, kind="stable")
                sigma = 1.4826 * far_off[order][np.searchsorted(np.cumsum(good[order]), good.sum() / 2)]  # of most documents, not of a few odd ones
                far = np.inf if over is None else max(over, middle + SPREAD * (1 + FEW / good.sum()) * sigma) / CELLS[1]
        return pd.DataFrame({"lang": [pdf["lang"].iat[0]], "least": [least], "most": [most], "far": pd.Series([far], dtype="float64")})

    return cells.groupBy("lang").applyInPandas(choose, "lang string, least double, most double, far double")


def judged(
    docs: DataFrame, labels: DataFrame, low: float = 0.002, high: float = 0.998, margin: float = 0.15,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", training: int | None = TRAINING, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, version, n_chars, perplexity, kept) of every row; labels: (doc_id, quality, toxic).

    The model is trained on all labelled documents but one fold, or with training on so many of them; edges are chosen by all labelled documents of that fold.
    """
    good, bad = (F.col("quality") == 1) & (F.col("toxic") == 0), (F.col("quality") == 0) | (F.col("toxic") == 1)
    said = labels.select(labels["doc_id"].cast("long").alias("doc_id"), F.coalesce(good, F.lit(False)).alias("good"), F.coalesce(bad, F.lit(False)).alias("bad"))
    labelled = said.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("good").alias("good"), F.max("bad").alias("bad")).filter("good or bad").select("doc_id", "good")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[lang_col].cast("string"), F.lit(ALL)).alias("lang"), docs[text_col].cast("string").alias("text"))
    in_training = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) != 0
    fold = labelled.filter(in_training)
    fold = saved(fold if training is None else fold.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(training), "fold")
    own = repeats.filtered(rows.filter(F.col("text").isNotNull()), fold, "doc_id").join(fold.hint("merge"), "doc_id")
    named = (F.col("lang") != ALL) & ~F.col("lang").startswith(AGAINST)
    times = own.filter(named).groupBy("lang").agg(F.sum(F.col("good").cast("long")).alias("n"), F.sum((~F.col("good")).cast("long")).alias("bad")).filter(F.col("n") >= MIN_TRUSTED)
    known = F.broadcast(saved(times.select("lang", (F.col("bad") >= MIN_TRUSTED).alias("contrasted")), "languages"))  # a row for each language of MIN_TRUSTED documents

    def with_models(x: DataFrame) -> DataFrame:
        model_of = F.when(F.col("contrasted"), F.col("lang")).otherwise(F.lit(ALL))
        x = x.join(known, "lang", "left").withColumn("against", F.concat(F.lit(AGAINST), model_of))
        return x.withColumn("lang", F.when(F.col("contrasted").isNotNull(), F.col("lang")).otherwise(F.lit(ALL))).drop("contrasted")

    learn = with_models(own).select(F.when(F.col("good"), F.col("lang")).otherwise(F.col("against")).alias("lang"), "text")
    done: list[str] = []
    trained = model(counts(learn, done))
    dropped(docs.sparkSession, done)
    versions = with_models(rows.withColumn("version", F.xxhash64("text"))).select("doc_id", "version", "lang", "against", "text")
    scores = saved(scored(versions, trained, block_bytes), "scores")
    held = scores.join(labelled.filter(~in_training), "doc_id").filter("perplexity is not null")
    ends = saved(edges(held.select("lang", "perplexity", "contrast", "good"), low, high, margin), "edges")
    whole = ends.filter("lang is null").select(*[F.col(c).alias(f"all_{c}") for c in ("least", "most", "far")])
    out = scores.join(F.broadcast(ends), "lang", "left").join(F.broadcast(whole), F.lit(True), "left")  # a row for each language, and one
    edge = {c: F.coalesce(c, f"all_{c}") for c in ("least", "most", "far")}
    inside = (F.col("perplexity") >= edge["least"]) & (F.col("perplexity") <= edge["most"]) & (F.col("contrast") <= edge["far"])
    kept = F.col("perplexity").isNotNull() & F.coalesce(inside, F.lit(True))
    return out.select("doc_id", "version", "n_chars", "perplexity", kept.alias("kept"))

"""Token-ID output: Parquet files of id lists in ascending document order.

Documents are dealt to shards by ranges of their id before they are encoded, so
a shard's file holds neighbouring documents in order and no id list is moved
again. Ids are a list column with dictionary pages (ids repeat, so a value takes
about 16 bits), counts and document ids are delta-coded (format version 2), row
groups and pages have set sizes, and Parquet's page index lets a reader fetch
the metadata columns, or the ids of a few documents, without the rest.

Edge cases: a null or empty text is the end id alone; rows with one document id
stay neighbours, ordered by their ids' checksum; a null document id sorts first;
an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import id_text, pieces, shared_dir
from tessera.llm.words import Words

#: Kinds of bytes in plain words: 1 for letters (A-Z, and U+00C0 to U+00FF as two bytes), 2 for punctuation that no
#: contraction or special token has. The tokenizer's pattern parts a plain word where the kind changes, and only there;
#: its normaliser lower-cases it.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = 1
_KIND[list(b'!"#$%&()*+,-./:;=?@[]^_`{}~')] = 2
#: Entries of a Python worker's word cache before it starts anew.
CACHE = 2_000_000
ROW_GROUP, PAGE = 64 << 20, 256 << 10
#: Bytes of text for which a shard of its own is made, where the session's partitions are fewer.
SHARD = 512 << 20


class Encoder:
    """The tokenizer, with the ids of words already met in one growing array.

    The tokenizer drops white space before its merges and neither its
    normaliser nor its pattern looks across an ASCII space, so each new word is
    encoded once, and plain words, cut at their punctuation, many to a call.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tok.get_vocab_size() + 1, bool)
        for piece, i in self.tok.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        """known: sorted numbers of words, slot: where start and size have their ids in pool, and check a second, independent hash."""
        self.known, self.slot, self.check = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
        self.start, self.size, self.pool = (np.zeros(0, t) for t in (np.int64, np.int32, np.uint32))

    def _find(self, numbers: np.ndarray) -> np.ndarray:
        """Slots of sorted numbers, -1 for new ones."""
        if not len(self.known):
            return np.full(len(numbers), -1)
        at = np.minimum(np.searchsorted(self.known, numbers), len(self.known) - 1)
        return np.where(self.known[at] == numbers, self.slot[at], -1)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([x for i in ids for x in i], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words, many to a call; each ends at its one id with an end mark."""
        out, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            n = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
            if len(n) != len(part):
                ids, n = self._each(part)
            out.append(ids)
            sizes.append(n)
        return np.concatenate(out), np.concatenate(sizes)

    def _add(self, words: Words, keys: np.ndarray, fresh: np.ndarray) -> None:
        for rows, ids_of in ((fresh[words.plain[fresh]], self._together), (fresh[~words.plain[fresh]], self._each)):
            ids, n = ids_of([w.decode() for w in words.raw(rows)])
            known = np.concatenate([self.known, keys[rows]])
            order = np.argsort(known, kind="stable")
            self.known, self.slot = known[order], np.concatenate([self.slot, np.arange(len(self.start), len(self.start) + len(rows), dtype=np.int32)])[order]
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(n) - n])
            self.size = np.concatenate([self.size, n])
            self.check = np.concatenate([self.check, words.check[rows]])
            self.pool = np.concatenate([self.pool, ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last's end)."""
        fold = not any("<|" in t for t in texts)  # special tokens keep their case
        words = Words(texts, b" \t\n\r", _KIND, 0xC3, (0x97, 0xB7), fold)
        if len(self.known) > CACHE:
            self.clear()
        numbers = words.key if fold else words.key ^ np.uint64(1)
        slot = self._find(numbers)
        fresh = np.flatnonzero(slot < 0)
        if len(fresh):
            self._add(words, numbers, fresh)
            slot = self._find(numbers)
        if not words.sound or (self.check[slot] != words.check).any():  # two words of one hash, here or before: by the library alone
            self.clear()
            ids, n = self._each(texts)
            return ids, np.concatenate([[0], np.cumsum(n)])
        slot = slot[words.label]
        size = self.size[slot].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.start[slot] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[words.doc]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", row_group: int = ROW_GROUP, page: int = PAGE) -> None:
    """Writes shard, doc_id, n_tokens, ids: one sorted run of documents per file. row_group and page: bytes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in pieces((b.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get) for b in batches), "text", chars=2_000_000):
            ids, ends = encoder(tokenizer).encode(pdf["text"].tolist())
            ids = np.insert(ids.astype(np.int32), ends[1:], end_id)
            ends = (ends + np.arange(len(ends))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pdf["shard"], pa.int32()), pa.array(pdf["doc_id"], pa.int64()), pa.array(np.diff(ends), pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))],
                names=["shard", "doc_id", "n_tokens", "ids"],
            )

    rows = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(int(size // SHARD) + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    (
        rows.repartitionByRange(shards, "doc_id")
        .sortWithinPartitions("doc_id")
        .withColumn("shard", F.spark_partition_id())
        .mapInArrow(run, "shard int, doc_id long, n_tokens int, ids array<int>")
        .write.option("compression", "zstd")
        .option("parquet.block.size", str(row_group))
        .option("parquet.page.size", str(page))
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("shard int, doc_id long, n_tokens int, ids array<int>").parquet(path)


def read_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents: row groups and pages without them are left out by their statistics."""
    return read(spark, path).filter(F.col("doc_id").isin(ids)).select("doc_id", "ids")


def index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from the files.

    start adds a document's place in its shard to the sum of the shards before.
    Only shard sums, one row per file, meet in one task.
    """

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.schema.get_field_index("ids"))
            at, flat = np.asarray(lists.offsets), np.asarray(lists.values).astype("<u4")
            sums = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(pc.cast(pc.list_value_length(lists), pa.int64())), pa.array(sums, pa.int64())], names=["shard", "doc_id", "n_tokens", "ids_crc32"]
            )

    rows = read(spark, path).select("shard", "doc_id", "ids").mapInArrow(crc, "shard int, doc_id long, n_tokens long, ids_crc32 long")
    totals = read(spark, path).groupBy("shard").agg(F.sum(F.col("n_tokens").cast("long")).alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    here = Window.partitionBy("shard").orderBy("doc_id", "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(here), F.lit(0)))
    return rows.join(totals, "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def written(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files below the shared folder and returns their index."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/tokens"
    write(docs, tokenizer, path, end_id, id_col, text_col)
    return index(spark, path)

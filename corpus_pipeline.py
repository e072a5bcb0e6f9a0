"""A corpus pipeline of five operators; each stage's output is written and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs. All but
the last return the columns of documents. Rows are told apart by id and text, so
repeated and null ids are no matter: a stage's decision reaches the rows it is
about and no others. Of rows that repeat both, near_dedup keeps one; rows with a
null id take no part in either deduplication and stay.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, decontaminate, line_dedup, near_dedup, quality
from tessera.llm.common import saved, small_batches, table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs less the rows of rejected (doc_id, version: the xxhash64 of the text)."""
    bad = rejected.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_version"))
    return docs.join(bad.hint("merge"), same, "left_anti")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the Kneser-Ney model of trusted text rejects."""
    return _without(docs, quality.judged(docs, table(spark, sf_dir, "labels")).filter(~F.col("kept")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines like a line of an earlier document or place, and documents that have no others."""
    out = line_dedup.rewritten(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, similarity 0.8), and one of rows that repeat id and text."""
    out = _without(docs, near_dedup.components(docs).filter(~F.col("kept")))
    same = ["doc_id", F.xxhash64("text").alias("version")]
    if not docs.filter("doc_id is not null").groupBy(*same).count().filter("count > 1").limit(1).count():
        return out
    return out.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(out.filter("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with ten consecutive words of a benchmark item, or a whole shorter item."""
    return _without(docs, decontaminate.hits(docs, table(spark, sf_dir, "benchmark")))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): byte-level BPE ids, and the digest of the bytes they decode to."""
    rank_file, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.round_trip(docs, rank_file, pattern)


def _stage(f: Stage) -> Stage:
    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality", _stage(quality_filter)),
    ("line_dedup", _stage(dedup_lines)),
    ("near_dedup", _stage(dedup_documents)),
    ("decontamination", _stage(decontaminated)),
    ("byte_bpe", _stage(tokenized)),
]

#: Several stages cannot be written in SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

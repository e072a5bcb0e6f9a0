"""The registered queries of the subpackage: thin callers of the operators, with production parameters."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, decontaminate, knn, line_dedup, near_dedup, quality, suffix_array, suffix_tree, token_count, token_files
from tessera.llm.common import small_batches, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.deduplicated(table(spark, sf_dir, "documents"), width=50).drop("kept")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(table(spark, sf_dir, "documents"), width=3, percent=85).drop("version")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = knn.integer_vectors(table(spark, sf_dir, "embeddings"), scale=64)
    return knn.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("version")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.deduplicated(table(spark, sf_dir, "documents"), width=50).drop("kept")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"), width=8, percent=80).drop("kept")


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {f.__name__: _query(f) for f in (op1_substring_dedup, op2_minhash_dedup, op3_token_counts, op4_knn, op5_quality, op6_decontamination, op7_token_files, op8_byte_bpe, op9_suffix_array_dedup, op10_line_dedup)}
ORACLE_SQL = {"op1_substring_dedup": suffix_tree.SQL, "op2_minhash_dedup": near_dedup.SQL, "op4_knn": knn.SQL, "op6_decontamination": decontaminate.SQL, "op9_suffix_array_dedup": suffix_array.SQL, "op10_line_dedup": line_dedup.SQL}

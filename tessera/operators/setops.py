"""Algebra of value sequences, with the multiplicities of sorted merges.

Inputs are DataFrames with one column of the same name. Results are unordered
unless said; sort them where they are shown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def intersect_left(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every row of a that has a match in b: left duplicates stay."""
    return a.join(b, a.columns, "left_semi")


def intersect_right(a: DataFrame, b: DataFrame) -> DataFrame:
    return intersect_left(b, a)


def multiset_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both."""
    return a.unionAll(b)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each row of b takes away one equal row of a."""
    return a.exceptAll(b)


def set_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows that are left of the multiset difference (not EXCEPT)."""
    return a.exceptAll(b).distinct()


def _ways(inputs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, [x.withColumn("_way", F.lit(i)) for i, x in enumerate(inputs)])


def kway_intersection(inputs: list[DataFrame], multiset: bool = True) -> DataFrame:
    """Values in all inputs: with the least of their multiplicities, or once."""
    name = inputs[0].columns[0]
    c = _ways(inputs).groupBy(name, "_way").agg(F.count("*").alias("_c")).groupBy(name).agg(F.count("*").alias("_n"), F.min("_c").alias("_least"))
    c = c.filter(F.col("_n") == len(inputs))
    if not multiset:
        return c.select(name)
    return c.select(name, F.explode(F.array_repeat(F.lit(0), F.col("_least").cast("int")))).select(name)


def kway_union(inputs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, inputs).distinct()


def frequency(inputs: list[DataFrame]) -> DataFrame:
    """(value, n): occurrences over all inputs."""
    return reduce(DataFrame.unionAll, inputs).groupBy(inputs[0].columns[0]).agg(F.count("*").alias("n"))


def filter_merge(inputs: list[DataFrame], predicate: Column) -> DataFrame:
    return reduce(DataFrame.unionAll, inputs).filter(predicate)


def merge_with_source(inputs: list[DataFrame]) -> DataFrame:
    """(value, source): of equal values those of earlier inputs first when sorted by both."""
    return _ways(inputs).withColumnRenamed("_way", "source")


def intersect_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row n: distinct common values."""
    return a.distinct().join(b.distinct(), a.columns, "left_semi").agg(F.count("*").alias("n"))


def without_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys, key, "left_anti")

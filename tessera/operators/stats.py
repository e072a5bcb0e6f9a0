"""Histograms, percentiles, moments, entropy and profiles of sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sequence import running_by


def histogram(rows: DataFrame, key: Column, weight: Column | None = None) -> DataFrame:
    """(key, n): weights by key."""
    return rows.groupBy(key.alias("key")).agg(F.sum(weight if weight is not None else F.lit(1)).alias("n"))


def summary(hist: DataFrame) -> DataFrame:
    """One row on a histogram; null means for an empty one."""
    total = F.sum("n")
    return hist.agg(
        F.count("*").alias("keys"), F.coalesce(total, F.lit(0)).alias("total"), F.sum(F.col("key") * F.col("n")).alias("weighted"), F.min("key").alias("min_key"), F.max("key").alias("max_key"),
        F.min("n").alias("min_count"), F.max("n").alias("max_count"), (F.sum(F.col("key") * F.col("n")) / total).alias("mean_key"), (total / F.count("*")).alias("mean_count"),
    )


def percentiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(p, key): the first key whose cumulated count reaches floor(total * p); none for p outside 0..1."""
    total = hist.agg(F.sum("n").alias("_total"))  # one row
    cumulated = running_by(hist, ["key"], F.col("n")).crossJoin(F.broadcast(total))
    each = cumulated.withColumn("p", F.explode(F.array(*[F.lit(p) for p in shares if 0 <= p <= 1])))
    return each.filter(F.col("running") >= F.floor(F.col("_total") * F.col("p"))).groupBy("p").agg(F.min("key").alias("key"))


def accumulate(rows: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """count, sum, min, max, mean, variance and deviation of the population; zeros where there is nothing."""
    zero = F.lit(0.0)
    return rows.groupBy(*(by or [])).agg(
        F.count(value).alias("n"), F.coalesce(F.sum(value), zero).alias("total"), F.coalesce(F.min(value), zero).alias("least"), F.coalesce(F.max(value), zero).alias("most"),
        F.coalesce(F.avg(value), zero).alias("mean"), F.coalesce(F.var_pop(value), zero).alias("variance"), F.coalesce(F.stddev_pop(value), zero).alias("deviation"),
    )


def byte_counts(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by, byte, n): how often each byte occurs, counted batch by batch."""
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema.fields}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            parts = []
            for key, part in pdf.groupby(by, dropna=False) if len(pdf) else ():
                n = np.bincount(np.frombuffer("".join(t for t in part[text] if t).encode(), np.uint8), minlength=256)
                at = np.flatnonzero(n)
                parts.append(pd.DataFrame({**{c: [k] * len(at) for c, k in zip(by, key)}, "byte": at, "n": n[at]}))
            if parts:
                yield pd.concat(parts)

    each = texts.select(*by, text).mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "byte int, n long"]))
    return each.groupBy(*by, "byte").agg(F.sum("n").alias("n"))


def text_profile(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, size, alphabet, repetition, run_length, bits) of each text's bytes.

    repetition: the share of bytes equal to the one before; run_length: the mean of runs; texts of one byte or none have 0 and 1,
    and an empty one 0 throughout.
    """
    kind = texts.schema[key].dataType.simpleString()

    def of(t: str | None) -> tuple:
        data = np.frombuffer((t or "").encode(), np.uint8)
        n = len(data)
        if not n:
            return 0, 0, 0.0, 0.0, 0.0
        same = int(np.count_nonzero(data[1:] == data[:-1]))
        p = np.bincount(data)
        p = p[p > 0] / n
        return n, len(p), same / n if n > 1 else 0.0, n / (n - same), float(-(p * np.log2(p)).sum()) + 0.0

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = pd.DataFrame([of(t) for t in pdf[text]], columns=["size", "alphabet", "repetition", "run_length", "bits"])
            rows.insert(0, key, pdf[key].to_numpy())
            yield rows

    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, size long, alphabet int, repetition double, run_length double, bits double")


def named(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(name, n, total, least, most, mean) of several named values, in one pass."""
    of = lambda name, v: F.struct(F.lit(name).alias("name"), F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"))
    return rows.agg(F.array(*[of(name, v.cast("double")) for name, v in values.items()]).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def entropy(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, bits): bits a byte of byte_counts."""
    total = Window.partitionBy(*by)
    p = F.col("n") / F.sum("n").over(total)
    return counts.withColumn("_part", -p * F.log2(p)).groupBy(*by).agg(F.sum("_part").alias("bits"))


def sequence_profile(rows: DataFrame, value: str, pos: str, by: list[str]) -> DataFrame:
    """Shares of differences that are zero, below 256, powers of two, or as the one before."""
    w = Window.partitionBy(*by).orderBy(pos)
    d = rows.withColumn("_d", F.col(value) - F.lag(value).over(w))
    d = d.withColumn("_same", F.col("_d") == F.lag("_d").over(w)).filter("_d is not null")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    x = F.col("_d")
    return d.groupBy(*by).agg(share(x == 0).alias("zero"), share((x >= 0) & (x < 256)).alias("small"), share((x > 0) & (F.bit_count(x.cast("long")) == 1)).alias("power"), share(F.col("_same")).alias("repeated"))


def sortedness(rows: DataFrame, value: str, pos: str, by: list[str]) -> DataFrame:
    """(by, n, inversions, nearly_sorted): adjacent descents."""
    w = Window.partitionBy(*by).orderBy(pos)
    d = rows.withColumn("_down", (F.col(value) < F.lag(value).over(w)).cast("int"))
    n = F.count("*")
    out = d.groupBy(*by).agg(n.alias("n"), F.coalesce(F.sum("_down"), F.lit(0)).alias("inversions"))
    limit = F.when(F.col("n") <= 10, F.greatest(F.lit(1), F.floor(F.col("n") / 5))).otherwise(F.floor(F.col("n") / 10))
    return out.withColumn("nearly_sorted", F.col("inversions") < limit)


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: common share of two key sets; 1 for two empty ones."""
    name = a.columns[0]
    both = a.distinct().withColumn("_a", F.lit(1)).join(b.distinct().withColumn("_b", F.lit(1)), name, "full_outer")
    return both.agg(F.coalesce(F.avg((F.col("_a").isNotNull() & F.col("_b").isNotNull()).cast("double")), F.lit(1.0)).alias("jaccard"))


def normalised(counts: DataFrame, total: int, by: list[str]) -> DataFrame:
    """counts (by, byte, n) with share: integers that sum to total, 1 at least for what occurs; rest by largest remainder."""
    sums = Window.partitionBy(*by)
    exact = F.col("n") * total / F.sum("n").over(sums)
    base = counts.withColumn("_exact", exact).withColumn("_base", F.greatest(F.floor("_exact"), F.lit(1)))
    order = Window.partitionBy(*by).orderBy(F.desc(F.col("_exact") - F.floor("_exact")), "byte")
    base = base.withColumn("_left", F.lit(total) - F.sum("_base").over(sums)).withColumn("_nr", F.row_number().over(order))
    large = Window.partitionBy(*by).orderBy(F.desc("_base"), "byte")
    more = F.when((F.col("_left") > 0) & (F.col("_nr") <= F.col("_left")), 1).otherwise(0)
    less = F.when((F.col("_left") < 0) & (F.row_number().over(large) == 1), F.col("_left")).otherwise(0)
    return base.withColumn("share", F.col("_base") + more + less).drop("_exact", "_base", "_left", "_nr")

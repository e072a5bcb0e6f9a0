"""Histograms, percentiles, moments, bytes and entropy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import stats
from tessera.plans.registry import query, table

_HIST = "(SELECT CAST(l_quantity AS BIGINT) AS key, count(*) AS n FROM lineitem GROUP BY 1)"


def _hist(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long"))


@query(f"SELECT key, n FROM {_HIST}")
def histogram(spark, sf_dir):
    return _hist(spark, sf_dir)


@query("SELECT CAST(l_quantity AS BIGINT) AS key, sum(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY 1")
def histogram_weighted(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long"), F.col("l_linenumber"))


@query(f"SELECT count(*) AS keys, sum(n)::BIGINT AS total, sum(key * n)::BIGINT AS weighted, min(key) AS min_key, max(key) AS max_key, min(n) AS min_count, max(n) AS max_count, sum(key * n) / sum(n) AS mean_key, sum(n) / count(*) AS mean_count FROM {_HIST}")
def histogram_summary(spark, sf_dir):
    return stats.summary(_hist(spark, sf_dir))


@query(f"WITH c AS (SELECT key, sum(n) OVER (ORDER BY key) AS upto, sum(n) OVER () AS total FROM {_HIST}) SELECT p, min(key) AS key FROM c, (SELECT unnest([0.0, 0.1, 0.5, 0.9, 0.99, 1.0])::DOUBLE AS p) WHERE upto >= floor(total * p) GROUP BY p")
def percentile_floor(spark, sf_dir):
    return stats.percentiles(_hist(spark, sf_dir), [0.0, 0.1, 0.5, 0.9, 0.99, 1.0, 1.5])


@query("SELECT l_returnflag, count(l_extendedprice) AS n, round(sum(l_extendedprice), 2) AS total, min(l_extendedprice) AS least, max(l_extendedprice) AS most, round(avg(l_extendedprice), 4) AS mean, round(var_pop(l_extendedprice) / 1e6, 4) AS variance, round(stddev_pop(l_extendedprice), 4) AS deviation FROM lineitem GROUP BY l_returnflag")
def accumulator(spark, sf_dir):
    a = stats.accumulate(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), ["l_returnflag"])
    return a.select("l_returnflag", "n", F.round("total", 2).alias("total"), "least", "most", F.round("mean", 4).alias("mean"), F.round(F.col("variance") / 1e6, 4).alias("variance"), F.round("deviation", 4).alias("deviation"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem")
def correlation(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("r"))


@query("SELECT ('0x' || substr(h, 2 * i + 1, 2))::INTEGER AS byte, count(*) AS n FROM (SELECT hex(encode(p_name)) AS h, unnest(range(0, strlen(p_name))) AS i FROM part) GROUP BY 1")
def byte_frequency(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name")
    return stats.byte_counts(names.withColumn("all", F.lit(0)), ["all"], "p_name").drop("all")


@query("WITH b AS (SELECT p_brand, ('0x' || substr(h, 2 * i + 1, 2))::INTEGER AS byte FROM (SELECT p_brand, hex(encode(p_name)) AS h, unnest(range(0, strlen(p_name))) AS i FROM part)), c AS (SELECT p_brand, byte, count(*) AS n FROM b GROUP BY 1, 2) SELECT p_brand, round(sum(-(n / t) * log2(n / t)), 8) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY p_brand) AS t FROM c) GROUP BY p_brand")
def entropy(spark, sf_dir):
    c = stats.byte_counts(table(spark, sf_dir, "part"), ["p_brand"], "p_name")
    return stats.entropy(c, ["p_brand"]).select("p_brand", F.round("bits", 8).alias("bits"))


@query(
    "WITH b AS (SELECT p_brand, ('0x' || substr(h, 2 * i + 1, 2))::INTEGER AS byte FROM (SELECT p_brand, hex(encode(p_name)) AS h, unnest(range(0, strlen(p_name))) AS i FROM part)), c AS (SELECT p_brand, byte, count(*) AS n FROM b GROUP BY 1, 2), "
    "x AS (SELECT *, n * 4096 / sum(n) OVER (PARTITION BY p_brand) AS exact FROM c), y AS (SELECT *, greatest(floor(exact)::BIGINT, 1) AS base, row_number() OVER (PARTITION BY p_brand ORDER BY exact - floor(exact) DESC, byte) AS nr FROM x), "
    "z AS (SELECT *, 4096 - sum(base) OVER (PARTITION BY p_brand) AS rest, row_number() OVER (PARTITION BY p_brand ORDER BY base DESC, byte) AS large FROM y) "
    "SELECT p_brand, byte, n, CAST(base + CASE WHEN rest > 0 AND nr <= rest THEN 1 ELSE 0 END + CASE WHEN rest < 0 AND large = 1 THEN rest ELSE 0 END AS BIGINT) AS share FROM z"
)
def normalised_frequencies(spark, sf_dir):
    """Byte counts scaled to a total of 4096, every byte that occurs at least once."""
    c = stats.byte_counts(table(spark, sf_dir, "part"), ["p_brand"], "p_name")
    return stats.normalised(c, 4096, ["p_brand"])


@query("SELECT min(l_extendedprice) AS least, max(l_extendedprice) AS most, min_by(l_orderkey * 8 + l_linenumber, struct_pack(v := l_extendedprice, i := l_orderkey * 8 + l_linenumber)) AS first_place FROM lineitem")
def min_max_place(spark, sf_dir):
    at = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").agg(F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"), F.min_by(at, F.struct(F.col("l_extendedprice"), at)).alias("first_place"))


@query("SELECT sum(bit_count(l_orderkey))::BIGINT AS ones FROM lineitem")
def popcount(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.sum(F.bit_count("l_orderkey")).alias("ones"))


@query("SELECT count(*) AS keys, sum(strlen(p_name))::BIGINT AS bytes, avg(strlen(p_name)) AS average, count(*) FILTER (WHERE p_name LIKE 'a%') AS with_prefix FROM part")
def store_statistics(spark, sf_dir):
    size = F.octet_length("p_name")
    return table(spark, sf_dir, "part").agg(F.count("*").alias("keys"), F.sum(size).alias("bytes"), F.avg(size).alias("average"), F.count_if(F.col("p_name").startswith("a")).alias("with_prefix"))

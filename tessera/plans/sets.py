"""Multiset and set algebra over key columns of lineitem, orders and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sequence, setops
from tessera.plans.registry import query, table


def _a(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("v"))


def _b(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").select(F.col("l_partkey").alias("v"))


def _c(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size < 10").select(F.col("p_partkey").alias("v"))


_A = "(SELECT l_partkey AS v FROM lineitem WHERE l_returnflag = 'R')"
_B = "(SELECT l_partkey AS v FROM lineitem WHERE l_linestatus = 'O')"
_C = "(SELECT p_partkey AS v FROM part WHERE p_size < 10)"
_ALL = f"(SELECT v, 0 AS w FROM {_A} UNION ALL SELECT v, 1 FROM {_B} UNION ALL SELECT v, 2 FROM {_C})"
_MIN = f"(SELECT v, min(c) AS c FROM (SELECT v, w, count(*) AS c FROM {_ALL} GROUP BY v, w) GROUP BY v HAVING count(*) = 3)"


@query(f"SELECT v, count(*) AS n FROM {_A} WHERE v IN (SELECT v FROM {_C}) GROUP BY v")
def multiset_intersection_l(spark, sf_dir):
    """Left rows with a match on the right, their repeats kept."""
    return setops.intersect_left(_a(spark, sf_dir), _c(spark, sf_dir)).groupBy("v").agg(F.count("*").alias("n"))


@query(f"SELECT v FROM {_C} WHERE v IN (SELECT v FROM {_A})")
def multiset_intersection_r(spark, sf_dir):
    return setops.intersect_right(_a(spark, sf_dir), _c(spark, sf_dir))


@query(f"SELECT v, count(*) AS n FROM (SELECT v FROM {_A} UNION ALL SELECT v FROM {_B}) GROUP BY v")
def multiset_union(spark, sf_dir):
    return setops.multiset_union(_a(spark, sf_dir), _b(spark, sf_dir)).groupBy("v").agg(F.count("*").alias("n"))


@query(f"SELECT v FROM {_A} EXCEPT ALL SELECT v FROM {_B}")
def multiset_difference(spark, sf_dir):
    return setops.multiset_difference(_a(spark, sf_dir), _b(spark, sf_dir))


@query(f"SELECT v FROM {_A} INTERSECT SELECT v FROM {_B}")
def set_intersection(spark, sf_dir):
    return setops.set_intersection(_a(spark, sf_dir), _b(spark, sf_dir))


@query(f"SELECT v FROM {_A} UNION SELECT v FROM {_C}")
def set_union(spark, sf_dir):
    return setops.set_union(_a(spark, sf_dir), _c(spark, sf_dir))


@query(f"SELECT DISTINCT v FROM (SELECT v FROM {_A} EXCEPT ALL SELECT v FROM {_B})")
def set_difference(spark, sf_dir):
    """Distinct rows of the multiset difference, which is not EXCEPT."""
    return setops.set_difference(_a(spark, sf_dir), _b(spark, sf_dir))


@query(f"SELECT v, c AS n FROM {_MIN}")
def kway_intersection(spark, sf_dir):
    """Values in three inputs, as often as in the one that has fewest."""
    return setops.kway_intersection([_a(spark, sf_dir), _b(spark, sf_dir), _c(spark, sf_dir)]).groupBy("v").agg(F.count("*").alias("n"))


@query(f"SELECT v FROM {_MIN}")
def kway_intersection_distinct(spark, sf_dir):
    return setops.kway_intersection([_a(spark, sf_dir), _b(spark, sf_dir), _c(spark, sf_dir)], multiset=False)


@query(f"SELECT DISTINCT v FROM {_ALL}")
def kway_union(spark, sf_dir):
    return setops.kway_union([_a(spark, sf_dir), _b(spark, sf_dir), _c(spark, sf_dir)])


@query(f"SELECT v, count(*) AS n FROM {_ALL} GROUP BY v")
def frequency_count(spark, sf_dir):
    return setops.frequency([_a(spark, sf_dir), _b(spark, sf_dir), _c(spark, sf_dir)])


@query(f"SELECT v FROM {_ALL} WHERE v % 7 = 3")
def filter_merge(spark, sf_dir):
    return setops.filter_merge([_a(spark, sf_dir), _b(spark, sf_dir), _c(spark, sf_dir)], F.col("v") % 7 == 3)


@query(f"SELECT count(*) AS n FROM (SELECT DISTINCT v FROM {_A} INTERSECT SELECT v FROM {_B})")
def posting_intersect_count(spark, sf_dir):
    return setops.intersect_count(_a(spark, sf_dir), _b(spark, sf_dir))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def key_removal(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return setops.without_keys(table(spark, sf_dir, "orders"), gone, "o_custkey").select("o_orderkey", "o_custkey")


@query(f"SELECT v, w AS source, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY v, w) - count(*) AS BIGINT) AS start FROM {_ALL} GROUP BY v, w")
def kway_merge(spark, sf_dir):
    """A stable merge: where the equal values of each input start in the merged order, and how many they are."""
    merged = setops.merge_with_source([_a(spark, sf_dir), _b(spark, sf_dir), _c(spark, sf_dir)])
    groups = merged.groupBy("v", "source").agg(F.count("*").alias("n")).withColumn("pos", F.col("v") * 3 + F.col("source"))
    return sequence.running_sum(groups, F.col("n"), inclusive=False).select("v", "source", "n", F.col("running").alias("start"))

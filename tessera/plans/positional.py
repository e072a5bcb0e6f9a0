"""Ordered data: rank and select, differences, runs, sorts, top k, cache contents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import sequence, stats
from tessera.plans.registry import query, table

_BITS = "(SELECT l_orderkey * 8 + l_linenumber AS pos, CAST(l_returnflag = 'R' AS INTEGER) AS bit, l_linestatus AS dim FROM lineitem)"
_SEQ = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"


def _bits(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), (F.col("l_returnflag") == "R").cast("int").alias("bit"), F.col("l_linestatus").alias("dim"))


def _seq(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("pos", F.row_number().over(w))


@query(f"SELECT DISTINCT pos, CAST(coalesce(sum(bit) OVER (ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rank1 FROM (SELECT pos, max(bit) AS bit FROM {_BITS} GROUP BY pos)")
def rank1(spark, sf_dir):
    """Ones before each place."""
    bits = _bits(spark, sf_dir).groupBy("pos").agg(F.max("bit").alias("bit"))
    return sequence.rank1(bits).select("pos", "rank1")


@query(f"SELECT row_number() OVER (ORDER BY pos) - 1 AS k, pos FROM (SELECT pos, max(bit) AS bit FROM {_BITS} GROUP BY pos) WHERE bit = 1")
def select1(spark, sf_dir):
    """The place of the k-th one, k from 0."""
    return sequence.select1(_bits(spark, sf_dir).groupBy("pos").agg(F.max("bit").alias("bit")))


@query(f"SELECT dim, row_number() OVER (PARTITION BY dim ORDER BY pos) - 1 AS k, pos FROM (SELECT dim, pos, max(bit) AS bit FROM {_BITS} GROUP BY dim, pos) WHERE bit = 1")
def select1_by_dimension(spark, sf_dir):
    return sequence.select1(_bits(spark, sf_dir).groupBy("dim", "pos").agg(F.max("bit").alias("bit")), by=["dim"])


@query("WITH b AS (SELECT DISTINCT l_partkey AS v FROM lineitem), w AS (SELECT v // 62 AS block, sum(1::BIGINT << CAST(v % 62 AS INTEGER))::BIGINT AS word FROM b GROUP BY 1) SELECT block, word, CAST(bit_count(word) AS INTEGER) AS ones FROM w")
def bitmap_words(spark, sf_dir):
    """A bitmap of keys in words, with their population counts."""
    b = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("v")).distinct()
    w = b.groupBy(F.floor(F.col("v") / 62).alias("block")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("v") % 62).cast("int"))).alias("word"))
    return w.withColumn("ones", F.bit_count("word"))


def _words(df, key):
    b = df.select(F.col(key).alias("v")).distinct()
    return b.groupBy(F.floor(F.col("v") / 62).alias("block")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("v") % 62).cast("int"))).alias("word"))


@query("WITH a AS (SELECT DISTINCT l_partkey AS v FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS v FROM lineitem WHERE l_quantity > 45), x AS (SELECT v // 62 AS block, sum(1::BIGINT << CAST(v % 62 AS INTEGER))::BIGINT AS w FROM a GROUP BY 1), y AS (SELECT v // 62 AS block, sum(1::BIGINT << CAST(v % 62 AS INTEGER))::BIGINT AS w FROM b GROUP BY 1) SELECT coalesce(x.block, y.block) AS block, coalesce(x.w, 0) & coalesce(y.w, 0) AS both, coalesce(x.w, 0) | coalesce(y.w, 0) AS any_, xor(coalesce(x.w, 0), coalesce(y.w, 0)) AS one FROM x FULL JOIN y ON x.block = y.block")
def bitmap_and_or_xor(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    x, y = _words(l.filter("l_returnflag = 'R'"), "l_partkey").withColumnRenamed("word", "x"), _words(l.filter("l_quantity > 45"), "l_partkey").withColumnRenamed("word", "y")
    a, b = F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))
    return x.join(y, "block", "full").select("block", a.bitwiseAND(b).alias("both"), a.bitwiseOR(b).alias("any_"), a.bitwiseXOR(b).alias("one"))


@query("WITH b AS (SELECT DISTINCT l_partkey AS v FROM lineitem WHERE l_quantity > 49), r AS (SELECT v, v - row_number() OVER (ORDER BY v) AS island FROM b) SELECT min(v) AS start, count(*) AS length FROM r GROUP BY island")
def runs_of_ones(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("pos")).distinct()
    r = sequence.running_sum(b, F.lit(1))
    return r.withColumn("island", F.col("pos") - F.col("running")).groupBy("island").agg(F.min("pos").alias("start"), F.count("*").alias("length")).drop("island")


@query(f"SELECT user_id, pos, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY pos), 0) AS delta FROM {_SEQ}")
def delta_encode(spark, sf_dir):
    return sequence.delta(_seq(spark, sf_dir), "event_id", "pos", ["user_id"]).select("user_id", "pos", "delta")


@query(f"SELECT user_id, pos, event_id AS value FROM {_SEQ}")
def delta_decode(spark, sf_dir):
    """Differences added up give back the values."""
    d = sequence.delta(_seq(spark, sf_dir), "event_id", "pos", ["user_id"]).select("user_id", "pos", "delta")
    return sequence.undelta(d, "pos", ["user_id"]).select("user_id", "pos", "value")


@query(f"SELECT user_id, pos, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) AS p FROM {_SEQ}) WHERE p IS DISTINCT FROM event_type")
def uniq_adjacent(spark, sf_dir):
    return sequence.uniq(_seq(spark, sf_dir), "event_type", "pos", ["user_id"]).select("user_id", "pos", "event_type")


@query(f"SELECT user_id, event_type, min(pos) AS start, count(*) AS length FROM (SELECT *, pos - row_number() OVER (PARTITION BY user_id, event_type ORDER BY pos) AS island FROM {_SEQ}) GROUP BY user_id, event_type, island")
def runs(spark, sf_dir):
    return sequence.runs(_seq(spark, sf_dir), "event_type", "pos", ["user_id"])


@query(f"SELECT user_id, pos, event_id, next FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY pos) AS next FROM {_SEQ}) WHERE next IS NOT NULL")
def adjacent_pairs(spark, sf_dir):
    return sequence.pairs(_seq(spark, sf_dir), "event_id", "pos", ["user_id"]).select("user_id", "pos", "event_id", "next")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id ORDER BY 2 DESC, 1 LIMIT 16")
def lru_final(spark, sf_dir):
    """What a cache of 16 users holds after all events."""
    return sequence.newest_keys(table(spark, sf_dir, "events"), "user_id", "event_id", 16)


@query(f"WITH d AS (SELECT user_id, pos, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY pos) AS d FROM {_SEQ}), e AS (SELECT user_id, d, d = lag(d) OVER (PARTITION BY user_id ORDER BY pos) AS same FROM d) SELECT user_id, avg(CAST(d = 0 AS INTEGER)) AS zero, avg(CAST(d >= 0 AND d < 256 AS INTEGER)) AS small, avg(CAST(d > 0 AND bit_count(d) = 1 AS INTEGER)) AS power, avg(CAST(coalesce(same, false) AS INTEGER)) AS repeated FROM e WHERE d IS NOT NULL GROUP BY user_id")
def sequence_patterns(spark, sf_dir):
    return stats.sequence_profile(_seq(spark, sf_dir), "event_id", "pos", ["user_id"])


@query(f"WITH d AS (SELECT user_id, CAST(value < lag(value) OVER (PARTITION BY user_id ORDER BY pos) AS INTEGER) AS down FROM {_SEQ}), s AS (SELECT user_id, count(*) AS n, coalesce(sum(down), 0)::BIGINT AS inversions FROM d GROUP BY user_id) SELECT user_id, n, inversions, inversions < CASE WHEN n <= 10 THEN greatest(1, n // 5) ELSE n // 10 END AS nearly_sorted FROM s")
def sortedness(spark, sf_dir):
    return stats.sortedness(_seq(spark, sf_dir), "value", "pos", ["user_id"])


@query("SELECT p_partkey, row_number() OVER (ORDER BY strlen(p_type), p_type, p_partkey) AS nr FROM part")
def sort_by_length(spark, sf_dir):
    """By bytes, ties by the text and the key."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.octet_length("p_type").alias("size"))
    return sequence.numbered(p, ["size", "p_type", "p_partkey"]).select("p_partkey", "nr")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey, o_orderkey) AS nr FROM orders")
def kv_stable_sort(spark, sf_dir):
    """Sorted by key, equal keys in input order."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey", "o_orderkey")
    return sequence.numbered_in_groups(o, ["o_orderpriority"], ["o_custkey", "o_orderkey"]).select("o_orderkey", "nr")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT p_name, k FROM (SELECT p_name, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS k FROM part) WHERE k IN (0, 10, 100)")
def kth_string(spark, sf_dir):
    firsts = table(spark, sf_dir, "part").orderBy("p_name", "p_partkey").limit(101)
    return firsts.withColumn("k", F.row_number().over(Window.orderBy("p_name", "p_partkey")) - 1).filter(F.col("k").isin(0, 10, 100)).select("p_name", "k")


#: Words of 64 bits in the SQL are unsigned; as signed numbers they are as Spark has them.
_SIGNED = "CAST(CASE WHEN {0} >= 9223372036854775808 THEN CAST({0} AS HUGEINT) - 18446744073709551616 ELSE CAST({0} AS HUGEINT) END AS BIGINT)"


@query(f"WITH s AS (SELECT o_orderkey AS id, o_totalprice > 150000 AS over FROM orders), w AS (SELECT id // 64 AS block, count(*) FILTER (WHERE over) AS n, coalesce(bit_or(1::UBIGINT << (id % 64)::UBIGINT) FILTER (WHERE over), 0::UBIGINT) AS mask FROM s GROUP BY 1) SELECT block, n, {_SIGNED.format('mask')} AS mask FROM w")
def block_filter(spark, sf_dir):
    """Per block of 64 ids: how many scores are above the threshold, and a mask in which bit i is the block's id number i; NaN is above nothing."""
    over = (F.col("o_totalprice") > 150000) & ~F.isnan(F.col("o_totalprice").cast("double"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("o_orderkey") % 64).cast("int"))
    return table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 64").alias("block")).agg(F.count_if(over).alias("n"), F.coalesce(F.bit_or(F.when(over, bit)), F.lit(0)).alias("mask"))


@query("SELECT l_orderkey, l_linenumber, sign(l_quantity - l_linenumber) AS cmp FROM lineitem")
def elementwise_compare(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.signum(F.col("l_quantity") - F.col("l_linenumber")).alias("cmp"))

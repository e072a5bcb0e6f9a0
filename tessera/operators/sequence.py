"""Operators on ordered data. Order is an explicit integer place.

Running values over a whole table go by blocks of places: sums of blocks are one
row a block, so only those are added up in one task, and the window itself runs
inside each block. Where the order is by other columns, rows are dealt to ranges
first and written, so that a range's number stays the same; what meets in one
task is one row a range.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.store import shared_dir

#: Places of a block.
BLOCK = 1 << 16


def running_sum(rows: DataFrame, value: Column, pos: str = "pos", inclusive: bool = True, by: list[str] | None = None) -> DataFrame:
    """rows with ``running``: the sum of value up to each place, or before it."""
    by = by or []
    rows = rows.withColumn("_value", value).withColumn("_block", F.floor(F.col(pos) / BLOCK))
    sums = rows.groupBy(*by, "_block").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    here = Window.partitionBy(*by, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = rows.join(base, [*by, "_block"]).withColumn("running", F.coalesce(F.sum("_value").over(here), F.lit(0)) + F.col("_base"))
    return out.drop("_value", "_block", "_base")


def rank1(bits: DataFrame, pos: str = "pos", bit: str = "bit", by: list[str] | None = None) -> DataFrame:
    """bits with rank1: ones before each place."""
    return running_sum(bits, F.col(bit).cast("long"), pos, False, by).withColumnRenamed("running", "rank1")


def select1(bits: DataFrame, pos: str = "pos", bit: str = "bit", by: list[str] | None = None) -> DataFrame:
    """(k, pos): the place of each one, k from 0."""
    ones = bits.filter(F.col(bit) == 1)
    return running_sum(ones, F.lit(1), pos, False, by).select(*(by or []), F.col("running").alias("k"), pos)


def rank0(bits: DataFrame, pos: str = "pos", bit: str = "bit", by: list[str] | None = None) -> DataFrame:
    """bits with rank0: zeros before each place."""
    return running_sum(bits, 1 - F.col(bit).cast("long"), pos, False, by).withColumnRenamed("running", "rank0")


def select0(bits: DataFrame, pos: str = "pos", bit: str = "bit", by: list[str] | None = None) -> DataFrame:
    """(k, pos): the place of each zero, k from 0."""
    zeros = bits.filter(F.col(bit) == 0)
    return running_sum(zeros, F.lit(1), pos, False, by).select(*(by or []), F.col("running").alias("k"), pos)


def count_range(bits: DataFrame, ranges: DataFrame, pos: str = "pos", bit: str = "bit") -> DataFrame:
    """ranges (start, stop) with ones: ones at places start..stop - 1. The ends are ranked together with the bits."""
    ends = ranges.select(F.col("start").alias(pos)).union(ranges.select("stop")).distinct().withColumn(bit, F.lit(0))
    every = bits.select(pos, F.col(bit).cast("int").alias(bit)).union(ends).groupBy(pos).agg(F.max(bit).alias(bit))
    ranks = rank1(every, pos, bit)
    at = lambda name: ranks.select(F.col(pos).alias(name), F.col("rank1").alias(f"_{name}"))
    return ranges.join(at("start"), "start").join(at("stop"), "stop").withColumn("ones", F.col("_stop") - F.col("_start")).drop("_start", "_stop")


def words_of(bits: DataFrame, pos: str = "pos") -> DataFrame:
    """(block, word): set places as words of 64 bits."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(pos), F.lit(64)).cast("int"))
    return bits.groupBy(F.expr(f"{pos} div 64").alias("block")).agg(F.bit_or(bit).alias("word"))


def set_range(words: DataFrame, start: int, stop: int, value: bool) -> DataFrame:
    """words with the bits start..stop - 1 set or cleared, a word at a time; words without a one are left out."""
    blocks = words.sparkSession.range(start // 64, (stop - 1) // 64 + 1 if stop > start else start // 64).select(F.col("id").alias("block"))
    low, high = F.greatest(start - F.col("block") * 64, F.lit(0)), F.least(stop - F.col("block") * 64, F.lit(64))
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (64 - (high - low)).cast("int"))  # every block has a bit of the range
    masks = blocks.select("block", F.call_function("shiftleft", ones, low.cast("int")).alias("mask"))
    word, mask = F.coalesce("word", F.lit(0).cast("long")), F.coalesce("mask", F.lit(0).cast("long"))
    new = word.bitwiseOR(mask) if value else word.bitwiseAND(F.bitwise_not(mask))
    return words.join(masks, "block", "full").select("block", new.alias("word")).filter("word <> 0")


def numbered_in_groups(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with ``nr``, from 1 in each group. A group may be the whole table: rows are numbered by ranges of all, less the group's first number."""
    every = numbered(rows, [*by, *order])
    first = every.groupBy(*by).agg(F.min("nr").alias("_first"))
    return every.join(first, by).withColumn("nr", F.col("nr") - F.col("_first") + 1).drop("_first")


def delta(rows: DataFrame, value: str, pos: str, by: list[str]) -> DataFrame:
    """rows with delta: the first value of a group, then differences."""
    w = Window.partitionBy(*by).orderBy(pos)
    return rows.withColumn("delta", F.col(value) - F.lag(value, 1, 0).over(w))


def undelta(rows: DataFrame, pos: str, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("value", F.sum("delta").over(w))


def uniq(rows: DataFrame, value: str, pos: str, by: list[str]) -> DataFrame:
    """rows without those equal to the one before."""
    w = Window.partitionBy(*by).orderBy(pos)
    first = F.row_number().over(w) == 1
    return rows.withColumn("_keep", first | ~F.col(value).eqNullSafe(F.lag(value).over(w))).filter("_keep").drop("_keep")


def runs(rows: DataFrame, value: str, pos: str, by: list[str]) -> DataFrame:
    """(by, value, start, length) of stretches of equal values."""
    w, v = Window.partitionBy(*by).orderBy(pos), Window.partitionBy(*by, value).orderBy(pos)
    island = rows.withColumn("_island", F.row_number().over(w) - F.row_number().over(v))
    return island.groupBy(*by, value, "_island").agg(F.min(pos).alias("start"), F.count("*").alias("length")).drop("_island")


def pairs(rows: DataFrame, value: str, pos: str, by: list[str]) -> DataFrame:
    """rows with next: the value that follows; last rows have none and are left out."""
    w = Window.partitionBy(*by).orderBy(pos)
    return rows.withColumn("next", F.lead(value).over(w)).filter(F.col("next").isNotNull())


def next_geq(lists: DataFrame, probes: DataFrame, by: list[str], value: str = "v", target: str = "target") -> DataFrame:
    """probes with idx and next: place (from 0) and value of the first element at or above the target, else null.

    A forward as-of join: elements and targets are sorted together, so it is one shuffle, not a range join. They go by
    downwards: Spark adds to a frame that begins with the group, and makes one that ends with it anew for every row.
    """
    w = Window.partitionBy(*by).orderBy(value)
    placed = lists.select(*by, value, (F.row_number().over(w) - 1).alias("idx"))
    both = placed.select(*by, F.col(value).alias("_k"), F.lit(1).alias("_side"), F.struct("idx", F.col(value).alias("next")).alias("_e"), F.lit(None).cast("struct<x:int>").alias("_p"))
    keep = [c for c in probes.columns if c not in by]
    asked = probes.select(*by, F.col(target).alias("_k"), F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_e"].dataType).alias("_e"), F.struct(*keep).alias("_p"))
    both = both.withColumn("_p", F.lit(None).cast(asked.schema["_p"].dataType))
    ahead = Window.partitionBy(*by).orderBy(F.desc("_k"), F.desc("_side"), F.desc("_e.idx")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.unionByName(asked).withColumn("_found", F.last("_e", ignorenulls=True).over(ahead)).filter("_side = 0")
    return out.select(*by, "_p.*", F.col("_found.idx").alias("idx"), F.col("_found.next").alias("next"))


def newest_keys(log: DataFrame, key: str, seq: str, capacity: int) -> DataFrame:
    """(key, seq) of the capacity keys used last, by last use: what a cache of that size holds."""
    return log.groupBy(key).agg(F.max(seq).alias(seq)).orderBy(F.desc(seq), key).limit(capacity)


def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ``_range``: numbers of ranges of the order, as a written table."""
    path = f"{shared_dir(rows.sparkSession)}/tessera-{uuid.uuid4().hex}/ranged"
    out = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    out.write.parquet(path)
    return rows.sparkSession.read.schema(out.schema).parquet(path)


def running_by(rows: DataFrame, order: list[str], value: Column, inclusive: bool = True) -> DataFrame:
    """rows with ``running``: the sum of value up to each row in the order of columns that tell all rows apart."""
    parts = ranged(rows.withColumn("_value", value), order)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("_range").agg(F.sum("_value").alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    here = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = parts.join(base, "_range").withColumn("running", F.coalesce(F.sum("_value").over(here), F.lit(0)) + F.col("_base"))
    return out.drop("_range", "_value", "_base")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ``nr``, from 1, in the order of columns that tell all rows apart."""
    return running_by(rows, order, F.lit(1)).withColumnRenamed("running", "nr")


def lower_bound(keys: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """targets (target) with lower (first key at or above) and upper (first above); nulls where there is none.

    Keys and targets are sorted together. A target takes the next key of its range, or the first key of a later one.
    Windows go downwards, as in next_geq.
    """
    k = keys.select(F.col(key).alias("_v")).filter("_v is not null").distinct().withColumn("_side", F.lit(1))
    t = targets.select(F.col("target").alias("_v")).filter("_v is not null").distinct()
    both = ranged(k.unionByName(t.withColumn("_side", F.lit(0))).unionByName(t.withColumn("_side", F.lit(2))), ["_v", "_side"])  # 0 stands before an equal key, 2 behind it
    firsts = both.filter("_side = 1").groupBy("_range").agg(F.min("_v").alias("_first"))
    ranges = both.select("_range").distinct().join(firsts, "_range", "left")
    later = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", F.last("_first", ignorenulls=True).over(later).alias("_later"))
    ahead = Window.partitionBy("_range").orderBy(F.desc("_v"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_next", F.last(F.when(F.col("_side") == 1, F.col("_v")), ignorenulls=True).over(ahead)).filter("_side <> 1")
    found = found.join(ranges, "_range").withColumn("_next", F.coalesce("_next", "_later"))
    pick = lambda side: F.max(F.when(F.col("_side") == side, F.col("_next")))
    bounds = found.groupBy(F.col("_v").alias("target")).agg(pick(0).alias("lower"), pick(2).alias("upper"))
    return targets.select("target").join(bounds, "target", "left").select("target", "lower", "upper")

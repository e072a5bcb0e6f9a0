"""Streams: chained stages, micro-batches, running counts, and windows of event time.

A failing row fails the query. Micro-batches are Spark's own, bounded by files
per trigger, so a slow sink holds back the source.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from tessera.sources.store import shared_dir

Stage = Callable[[DataFrame], DataFrame]


def source(spark: SparkSession, path: str, schema: StructType | str, files: int = 16) -> DataFrame:
    """A stream of Parquet files, at most ``files`` of them a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def map_stage(**columns: Column) -> Stage:
    return lambda df: df.withColumns(columns)


def filter_stage(condition: Column, keep_nulls: bool = False) -> Stage:
    """Drops rows; with keep_nulls a rejected row stays with all its columns null."""
    if not keep_nulls:
        return lambda df: df.filter(condition)
    return lambda df: df.select(*[F.when(condition, F.col(c)).alias(c) for c in df.columns])


def batch_stage(function, schema: str) -> Stage:
    """A function on pandas frames, Arrow batch by Arrow batch."""
    return lambda df: df.mapInPandas(function, schema)


def chained(df: DataFrame, *stages: Stage) -> DataFrame:
    for stage in stages:
        df = stage(df)
    return df


def running(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Counters that every micro-batch updates."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def first_seen(df: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key; keys are forgotten when the watermark passes them."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed(df: DataFrame, time: str, size: str, delay: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Counts in windows of event time; rows later than delay are dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return df.withWatermark(time, delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(df: DataFrame, time: str, gap: str, delay: str, by: list[str]) -> DataFrame:
    s = F.session_window(time, gap)
    return df.withWatermark(time, delay).groupBy(s.alias("s"), *by).agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), *by, "n")


def to_table(df: DataFrame, name: str, mode: str) -> StreamingQuery:
    """Writes to a table in memory; for tests and small results."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()


#: State on the executors' disks with bounded memory, so that it may outgrow their heaps.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def to_files(df: DataFrame, path: str, mode: str) -> StreamingQuery:
    """Writes each micro-batch to Parquet files of its own, from the executors; nothing comes to the driver."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        conf.set(k, v)
    try:  # a query keeps the settings that it started with
        out = df.writeStream.outputMode(mode).foreachBatch(lambda batch, nr: batch.write.mode("overwrite").parquet(f"{path}/b{nr:09d}"))
        return out.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def result(df: DataFrame, mode: str) -> DataFrame:
    """What a stream has written in the end: all micro-batches in mode append, the last one in mode complete."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/result"
    finished(to_files(df, path, mode))
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = sorted(n for x in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root) if (n := x.getPath().getName()).startswith("b"))
    names = names[-1:] if mode == "complete" else names
    return spark.read.schema(df.schema).parquet(*[f"{path}/{n}" for n in names]) if names else spark.createDataFrame([], df.schema)


#: Parts of an upserted table; a micro-batch rewrites those that its keys are in.
PARTS = 64


def upserts(df: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, parts: int = PARTS) -> StreamingQuery:
    """Keeps the newest row of each key in a Parquet table dealt to parts by key. A micro-batch writes new versions of the parts it touches; replays give the same table."""

    def merge(batch: DataFrame, nr: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        touched = [r["part"] for r in batch.select("part").distinct().collect()]  # parts at most
        current = _versions(spark, path, nr)
        old = [current[p] for p in touched if p in current]
        rows = batch
        if old:
            kept = StructType([f for f in batch.schema.fields if f.name != "part"])
            rows = batch.unionByName(spark.read.schema(kept).parquet(*old).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")))
        others = [c for c in batch.columns if c not in (*keys, "part")]
        newest = rows.groupBy("part", *keys).agg(F.max_by(F.struct(*others), order).alias("_r")).select("part", *keys, "_r.*")
        newest.write.mode("overwrite").partitionBy("part").parquet(f"{path}/b{nr:09d}")

    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, str]:
    """The newest written version of each part, of micro-batches before a number."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[int, str] = {}
    names = sorted(x.getPath().getName() for x in fs.listStatus(root)) if fs.exists(root) else []
    for name in names:
        if not name.startswith("b") or (before is not None and int(name[1:]) >= before) or not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
            continue
        for x in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")):
            if (at := x.getPath().getName()).startswith("part="):
                out[int(at[5:])] = f"{path}/{name}/{at}"
    return out


def upserted(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table that upserts keeps."""
    at = _versions(spark, path)
    return spark.read.schema(schema).parquet(*at.values()) if at else spark.createDataFrame([], schema)


def joined(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, delay: str) -> DataFrame:
    """Pairs of two streams with one key whose right time is at or behind the left one, by at most within; state older than the watermarks goes."""
    a, b = left.withWatermark(left_time, delay), right.withWatermark(right_time, delay)
    return a.join(b, (a[key] == b[key]) & (b[right_time] >= a[left_time]) & (b[right_time] <= a[left_time] + F.expr(f"interval {within}"))).drop(b[key])


def timed_batches(df: DataFrame, function: Callable[[DataFrame, int], None], seconds: float, checkpoint: str) -> StreamingQuery:
    """Calls function with micro-batches of what has come, at most every so many seconds of processing time."""
    return df.writeStream.foreachBatch(function).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def line_source(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """A stream of the lines of text files (value); it goes forward only."""
    return spark.readStream.option("maxFilesPerTrigger", files).text(path)


def finished(query: StreamingQuery) -> None:
    query.processAllAvailable()
    query.awaitTermination()


def replayed(spark: SparkSession, rows: DataFrame, name: str, parts: int = 4) -> DataFrame:
    """A batch table as a stream of about ``parts`` micro-batches."""
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/{name}"
    rows.repartition(parts).write.parquet(path)
    return source(spark, path, rows.schema, 1)

"""Record stores: tables (record_id, data) below a path, written as Parquet.

A store is a folder of immutable parts: records that were put, ids that were
removed, and compactions of all that lives. A change writes one part of its own
size and touches no other; a reader takes the parts that are whole, from the
last compaction on, so it never sees half of a change. Ids are never used again.
"""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tessera-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or, where that is unset and all run in one process, a folder of this one's own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _own_dir()
    return at.rstrip("/")


class RecordStore:
    """put, get, remove and scan of opaque records; ids are longs that put counts up."""

    SCHEMA = "record_id long, data binary"

    def __init__(self, spark: SparkSession, path: str, compression: str = "zstd") -> None:
        self.spark, self.path, self.compression = spark, path.rstrip("/"), compression

    def _parts(self) -> list[tuple[int, str, int, str]]:
        """(number, kind, next id, path) of the whole parts in order, from the last compaction on. Kinds: a added, d removed, c compacted."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = []
        for x in fs.listStatus(root):
            name = x.getPath().getName()
            if (m := re.fullmatch(r"(\d+)-([adc])-(\d+)-\w+", name)) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")):
                found.append((int(m[1]), m[2], int(m[3]), f"{self.path}/{name}"))
        found.sort()
        last = max((i for i, part in enumerate(found) if part[1] == "c"), default=0)
        return found[last:]

    def _add(self, rows: DataFrame, kind: str, next_id: int, parts: list) -> str:
        nr = parts[-1][0] + 1 if parts else 0
        path = f"{self.path}/{nr:012d}-{kind}-{next_id:019d}-{uuid.uuid4().hex[:8]}"
        rows.write.option("compression", self.compression).parquet(path)
        return path

    def _live(self, parts: list) -> DataFrame:
        added, gone = [p[3] for p in parts if p[1] != "d"], [p[3] for p in parts if p[1] == "d"]
        if not added:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(*added)
        return rows.join(self.spark.read.schema("record_id long").parquet(*gone), "record_id", "left_anti") if gone else rows

    def scan(self) -> DataFrame:
        """All records; sort by record_id where order matters."""
        return self._live(self._parts())

    def put_batch(self, records: DataFrame, order: str) -> DataFrame:
        """Adds records (order, data); returns (order, record_id), ids counted up in order from the greatest there ever was."""
        from tessera.operators.sequence import running_sum

        parts = self._parts()
        base = parts[-1][2] if parts else 0
        placed = running_sum(records.select(order, "data"), F.lit(1), order).withColumn("record_id", F.col("running") + (base - 1)).drop("running")
        self._add(placed.select("record_id", "data"), "a", base + records.count(), parts)
        return placed.select(order, "record_id")

    def get(self, record_id: int) -> bytes:
        row = self.scan().filter(F.col("record_id") == record_id).first()
        if row is None:
            raise KeyError(record_id)
        return bytes(row["data"])

    def get_batch(self, ids: DataFrame, order: str = "pos") -> DataFrame:
        """(order, record_id, data): data is null for a miss."""
        return ids.join(self.scan(), "record_id", "left").select(order, "record_id", "data")

    def remove_batch(self, ids: DataFrame) -> int:
        """Removes records; returns how many there were."""
        parts = self._parts()
        there = self._live(parts).select("record_id").join(ids.select("record_id").distinct(), "record_id", "left_semi")
        path = self._add(there, "d", parts[-1][2] if parts else 0, parts)
        return self.spark.read.schema("record_id long").parquet(path).count()

    def compact(self) -> None:
        """Writes all that lives as one part, from which readers start."""
        parts = self._parts()
        if parts:
            self._add(self._live(parts), "c", parts[-1][2], parts)

    def with_sizes(self) -> DataFrame:
        return self.scan().withColumn("size", F.octet_length("data"))


def by_prefix(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows whose key has the prefix; the filter reaches the Parquet scan."""
    return rows.filter(F.col(key).startswith(prefix))


def length_split(records: DataFrame, data: str = "data") -> DataFrame:
    """records with is_fixed: whether a record has the commonest length (the least of several)."""
    sizes = records.groupBy(F.octet_length(data).alias("_n")).agg(F.count("*").alias("_c"))
    best = sizes.agg(F.max_by("_n", F.struct(F.col("_c"), -F.col("_n"))).alias("_n"))  # one row
    return records.crossJoin(F.broadcast(best)).withColumn("is_fixed", F.octet_length(data) == F.col("_n")).drop("_n")


def fragments(records: DataFrame, key: str, text: str, delimiters: str = ",", least: int = 0, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """((fragment_id, fragment), (key, ids)): records cut into fragments, each distinct fragment once.

    A fragment ends behind the first delimiter from its byte number least on, or has most bytes where there is none.
    fragment_id is the 128-bit digest of the fragment's bytes.
    """
    if not 0 <= least < most:
        raise ValueError("fragments need 0 <= least < most")
    ends = b"[" + b"".join(re.escape(bytes([b])) for b in delimiters.encode()) + b"]"
    cut = re.compile(b"(?s:.{%d}.{0,%d}?%s|.{1,%d})" % (least, most - least - 1, ends, most))

    @F.pandas_udf("array<binary>")
    def parts(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else cut.findall(x))

    each = records.select(key, F.posexplode_outer(parts(F.col(text).cast("binary"))).alias("_i", "fragment")).withColumn("fragment_id", F.md5("fragment"))
    pool = each.filter("fragment is not null").select("fragment_id", "fragment").dropDuplicates(["fragment_id"])
    lists = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("fragment_id").isNotNull(), F.struct("_i", "fragment_id")))), lambda x: x["fragment_id"]).alias("ids"))
    return pool, lists


def restored(pool: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """(key, data binary): records put together from their fragments."""
    each = lists.select(key, F.posexplode_outer("ids").alias("_i", "fragment_id")).join(pool, "fragment_id", "left")
    pieces = F.array_sort(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", F.hex("fragment").alias("_h")))))
    return each.groupBy(key).agg(F.unhex(F.array_join(F.transform(pieces, lambda x: x["_h"]), "")).alias("data"))


def reorder(rows: DataFrame, permutation: DataFrame, pos: str = "pos") -> DataFrame:
    """rows with new_pos of permutation (pos, new_pos)."""
    return rows.join(permutation, pos)


def reorder_runs(permutation: DataFrame) -> DataFrame:
    """(start, new_start, length, step): permutation (pos, new_pos) as stretches in which new places go up or down by one."""
    from tessera.operators.sequence import running_sum

    before = permutation.select((F.col("pos") + 1).alias("pos"), F.col("new_pos").alias("_before"))
    each = permutation.join(before, "pos", "left").withColumn("_step", F.col("new_pos") - F.col("_before"))
    first = F.when(F.abs("_step") == 1, 0).otherwise(1)
    each = running_sum(each.withColumn("_step", F.coalesce("_step", F.lit(0))), F.coalesce(first, F.lit(1)), "pos")
    step = F.max(F.when(F.abs("_step") == 1, F.struct("pos", "_step")))["_step"]
    out = each.groupBy("running").agg(F.min("pos").alias("start"), F.min_by("new_pos", "pos").alias("new_start"), F.count("*").alias("length"), step.alias("step"))
    return out.select("start", "new_start", "length", F.when(F.col("length") > 1, F.col("step")).otherwise(1).cast("int").alias("step"))


def reorder_of(runs: DataFrame) -> DataFrame:
    """(pos, new_pos) of reorder_runs."""
    each = runs.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)))
    return each.select((F.col("start") + F.col("_i")).alias("pos"), (F.col("new_start") + F.col("step") * F.col("_i")).alias("new_pos"))


class FolderStore:
    """A folder for each record below a path: a record is got, put or removed without a look at others."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def put_batch(self, records: DataFrame) -> None:
        """Adds records (record_id, data)."""
        records.select("record_id", "data").write.mode("append").partitionBy("record_id").parquet(self.path)

    def get(self, record_id: int) -> bytes:
        if not self._fs().exists(self._at(record_id)):
            raise KeyError(record_id)
        return bytes(self.spark.read.schema("data binary").parquet(f"{self.path}/record_id={record_id}").first()["data"])

    def remove(self, record_id: int) -> bool:
        return bool(self._fs().delete(self._at(record_id), True))

    def scan(self) -> DataFrame:
        return self.spark.read.schema("data binary, record_id long").parquet(self.path).select("record_id", "data")

    def _at(self, record_id: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/record_id={record_id}")

    def _fs(self):
        return self._at(0).getFileSystem(self.spark._jsc.hadoopConfiguration())


def read_versions(spark: SparkSession, paths: list[str], schema: str, defaults: dict[str, object]) -> DataFrame:
    """Rows of files of several versions of a schema: a field that a version lacks has its default, one that it alone has is left out."""
    fields = spark.createDataFrame([], schema).schema.fields
    out = None
    for path in paths:
        rows = spark.read.parquet(path)
        rows = rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in fields])
        out = rows if out is None else out.unionAll(rows)
    return out

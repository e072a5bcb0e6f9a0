"""Helpers shared by the training-data operators.

Conventions of the whole subpackage:

* an operator reads an id column and a text column and ignores every other
  column, so extra columns and clashing names cannot reach its plan;
* a null text holds nothing (no words, no bytes, no tokens);
* intermediate tables that cut lineage are Parquet tables below the folder in
  ``spark.checkpoint.dir``, which driver and executors share.
"""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Fixed value: sha256 of no bytes.
EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


#: Rows in a batch between the JVM and Python that suit long texts; both sides hold a batch.
ARROW_ROWS = "1500"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """For applications, as the registered queries are: asks for batches of ARROW_ROWS where the session has Spark's default. Operators leave the session alone."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


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


#: Spark's setting by which a write removes its own shuffle files when it is done; else they stay until the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """For what is run inside; the session's own setting is back afterwards."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def saved(df: DataFrame, name: str, codec: str = "zstd", into: list[str] | None = None) -> DataFrame:
    """Writes df once and returns the written table, so that later plans start from files; its folder's name goes into a list, for dropped().

    What the write has shuffled is removed at once, so that an operator of many tables holds one table's shuffles at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/{name}"
    with _shuffles_removed(spark):
        df.write.option("compression", codec).parquet(path)
    if into is not None:
        into.append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Removes written tables that no plan reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): all that an operator takes from its input."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def each_row(rows: DataFrame, run: Callable[..., dict[str, list]], schema: str, chars: int = 4_000_000, frame: bool = False) -> DataFrame:
    """rows (doc_id, ..., text) without text, with the columns that run makes of the texts (null: empty); one row each.

    With frame, run gets the whole frame and the texts may be null. Ids travel without nulls, since pandas would turn a long column with a null into floats.
    """
    keep = [c for c in rows.columns if c != "text"]
    sent = rows.withColumn("no_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("long")))

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(frames, "text", chars):
            out = pdf[[*keep, "no_id"]].reset_index(drop=True)
            yield out.assign(**run(pdf if frame else [t or "" for t in pdf["text"]]))

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    made = sent.mapInPandas(over, ", ".join([*(f"{c} {types[c]}" for c in keep), "no_id boolean", schema]))
    return made.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def pieces(frames: Iterator[pd.DataFrame], column: str, chars: int = 4_000_000, rows: int = 4096) -> Iterator[pd.DataFrame]:
    """Cuts Arrow batches into frames of bounded text; one longer text is a frame of its own."""
    for pdf in frames:
        start, held = 0, 0
        sizes = pdf[column].str.len().fillna(0).astype("int64").tolist()
        for i, n in enumerate(sizes):
            if i > start and (held + n > chars or i - start >= rows):
                yield pdf.iloc[start:i]
                start, held = i, 0
            held += n
        if start < len(pdf):
            yield pdf.iloc[start:]

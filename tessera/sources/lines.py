"""Lines of texts: numbering, batches, filters, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def numbered(rows: DataFrame, key: str, text: str, trim: bool = False, skip_empty: bool = False) -> DataFrame:
    """(key, line_no from 1, line). Skipped empty lines take no number."""
    line = F.regexp_replace("line", "\r$", "")
    out = rows.select(key, F.posexplode_outer(F.split(F.col(text), "\n", -1)).alias("_i", "line")).filter("line is not null").withColumn("line", line)
    if trim:
        out = out.withColumn("line", F.btrim("line", F.lit(" \t\r\x0b\x0c")))
    if not skip_empty:
        return out.select(key, (F.col("_i") + 1).alias("line_no"), "line")
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("_i")
    return out.filter("line <> ''").select(key, F.row_number().over(w).alias("line_no"), "line")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, line): lines of text files, split where Spark splits files."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line"))


def batches(lines: DataFrame, size: int) -> DataFrame:
    return lines.withColumn("batch", F.floor((F.col("line_no") - 1) / size))


def by_length(lines: DataFrame, least: int, most: int) -> DataFrame:
    """Lines of least to most bytes, both included."""
    return lines.filter(F.octet_length("line").between(least, most))


def fields(lines: DataFrame, separator: str) -> DataFrame:
    """lines with field_no (from 0) and field."""
    return lines.select("*", F.posexplode(F.split("line", "\\Q" + separator + "\\E", -1)).alias("field_no", "field"))


def statistics(lines: DataFrame, by: list[str]) -> DataFrame:
    """Lines, characters, bytes, words, empty lines, longest and shortest line in bytes."""
    size = F.octet_length("line")
    return lines.groupBy(*by).agg(
        F.count("*").alias("lines"), F.sum(F.char_length("line")).alias("chars"), F.sum(size).alias("bytes"), F.sum(F.regexp_count("line", F.lit(r"[^ \t\n\x0B\f\r]+"))).alias("words"),
        F.count_if(F.btrim("line", F.lit(" \t\r\x0b\x0c")) == "").alias("empty"), F.max(size).alias("longest"), F.min(size).alias("shortest"),
    )

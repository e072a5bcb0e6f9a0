"""Ranked retrieval: postings, document frequencies, BM25 with one-byte length norms, top k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.bits import fieldnorm_decode, fieldnorm_encode
from tessera.functions.text import WORD, words

K1, B = 1.2, 0.75


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, tf), of the given terms (term) alone if there are any."""
    each = docs.select("doc_id", F.explode(words(F.col("text"))).alias("term"))
    if terms is not None:
        each = each.join(terms.select("term"), "term", "left_semi")
    return each.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(words(F.coalesce("text", F.lit("")))).cast("long").alias("dl"))


def norm(code: Column, average: Column) -> Column:
    return K1 * (1 - B + F.when(average > 0, B * fieldnorm_decode(code) / average).otherwise(F.lit(0.0)))


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def scores(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(query, doc_id, score) of terms (query, term): each term's part is added up by document.

    A document is split once: its words bring its length along. Number and mean length of all documents only count words.
    """
    each = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("dl"), F.explode("w").alias("term"))
    tf = each.join(terms.select("term").distinct(), "term").groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    whole = docs.agg(F.count("*").alias("n"), F.avg(size).alias("average"))  # one row
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    hit = tf.join(df, "term").crossJoin(F.broadcast(whole))
    part = idf(F.col("n"), F.col("df")) * (K1 + 1) * F.col("tf") / (F.col("tf") + norm(fieldnorm_encode(F.col("dl")), F.col("average")))
    return hit.withColumn("part", part).join(terms, "term").groupBy("query", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of all; ties to the smaller doc_id."""
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def top_each(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with their rank."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def frequent_terms(texts: DataFrame, k: int, least: int = 4) -> DataFrame:
    """(term, c): the k commonest words of at least least characters, by count and then by name."""
    each = texts.select(F.explode(words(F.col("text"))).alias("term")).filter(F.length("term") >= least)
    return each.groupBy("term").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "term").limit(k)

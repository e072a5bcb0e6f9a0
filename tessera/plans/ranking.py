"""Ranked search over documents, with query terms drawn from the benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.bits import fieldnorm_decode, fieldnorm_encode
from tessera.functions.text import words
from tessera.operators import ranking
from tessera.plans.registry import query, table

_W = "regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+')"
_ENCODE = "CASE WHEN dl < 8 THEN dl ELSE (length(bin(dl)) - 3) * 8 + ((dl >> CAST(length(bin(dl)) - 4 AS INTEGER)) & 7) END"
_DECODE = "CASE WHEN code < 8 THEN code ELSE (8 + code % 8) << CAST(code // 8 - 1 AS INTEGER) END"
_BASE = f"""
WITH t AS (SELECT {{query}} AS query, term FROM (SELECT term, count(*) AS c FROM (SELECT unnest({_W}) AS term FROM benchmark) WHERE length(term) >= 4 GROUP BY term ORDER BY c DESC, term LIMIT {{k}})),
p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_W}) AS term FROM documents) WHERE term IN (SELECT term FROM t) GROUP BY term, doc_id),
l AS (SELECT doc_id, CAST(len({_W}) AS BIGINT) AS dl FROM documents), e AS (SELECT doc_id, dl, {_ENCODE} AS code FROM l), g AS (SELECT doc_id, {_DECODE} AS dl FROM e),
a AS (SELECT count(*) AS n, avg(dl) AS average FROM l), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT query, p.doc_id AS doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * g.dl / average))), 6) AS score
      FROM p JOIN g ON p.doc_id = g.doc_id JOIN f ON p.term = f.term JOIN t ON p.term = t.term CROSS JOIN a GROUP BY query, p.doc_id)
"""


@query(_BASE.format(query="0", k=3) + "SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark, sf_dir):
    """The ten best documents for the three commonest words of the benchmark."""
    terms = ranking.frequent_terms(table(spark, sf_dir, "benchmark"), 3).select(F.lit(0).alias("query"), "term")
    return ranking.top(ranking.scores(table(spark, sf_dir, "documents"), terms), 10).select("doc_id", "score")


@query(_BASE.format(query="term", k=20) + "SELECT query, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5")
def bm25_topk_per_query(spark, sf_dir):
    """The five best documents for each of twenty words."""
    terms = ranking.frequent_terms(table(spark, sf_dir, "benchmark"), 20).select(F.col("term").alias("query"), "term")
    return ranking.top_each(ranking.scores(table(spark, sf_dir, "documents"), terms), 5)


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_W}) AS term FROM documents) GROUP BY doc_id, term")
def doc_tf(spark, sf_dir):
    return ranking.postings(table(spark, sf_dir, "documents"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_W}) AS term FROM documents) GROUP BY term")
def doc_df(spark, sf_dir):
    return ranking.postings(table(spark, sf_dir, "documents")).groupBy("term").agg(F.count("*").alias("df"))


@query(f"SELECT doc_id, len({_W}) AS n FROM documents")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words(F.coalesce("text", F.lit("")))).alias("n"))


@query(f"WITH l AS (SELECT doc_id, CAST(len({_W}) AS BIGINT) AS dl FROM documents), e AS (SELECT doc_id, dl, {_ENCODE} AS code FROM l) SELECT doc_id, dl, code, {_DECODE} AS least FROM e")
def fieldnorm(spark, sf_dir):
    e = ranking.lengths(table(spark, sf_dir, "documents")).withColumn("code", fieldnorm_encode(F.col("dl")))
    return e.withColumn("least", fieldnorm_decode(F.col("code")))


@query(f"SELECT term, list_sort(list_distinct(list(doc_id))) AS ids, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest({_W}) AS term FROM documents) GROUP BY term")
def posting_lists(spark, sf_dir):
    p = ranking.postings(table(spark, sf_dir, "documents"))
    return p.groupBy("term").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"), F.count("*").alias("n"))

"""Dictionary search: membership, prefixes, ranges, bounds, edit distance, many patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import as_bytes, common_prefix, words
from tessera.operators import search, sequence, stats
from tessera.plans.registry import query, table

_W = "regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+')"
_TERMS = f"(SELECT DISTINCT unnest({_W}) AS term FROM documents)"
_BENCH = f"(SELECT DISTINCT unnest({_W}) AS term FROM benchmark)"


def _terms(spark, sf_dir, name="documents"):
    return table(spark, sf_dir, name).select(F.explode(words(F.col("text"))).alias("term")).distinct()


@query(f"SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM {_TERMS}")
def term_dictionary(spark, sf_dir):
    return search.dictionary(_terms(spark, sf_dir), "term")


@query(f"SELECT b.term AS term, d.term IS NOT NULL AS found FROM {_BENCH} b LEFT JOIN {_TERMS} d ON b.term = d.term")
def batch_membership(spark, sf_dir):
    return search.membership(_terms(spark, sf_dir, "benchmark"), _terms(spark, sf_dir), "term")


@query(f"SELECT term FROM {_TERMS} WHERE term LIKE 'the%'")
def prefix_search(spark, sf_dir):
    return search.with_prefix(_terms(spark, sf_dir), "term", "the")


@query(f"WITH p AS (SELECT DISTINCT substr(term, 1, 4) AS prefix FROM {_BENCH} WHERE length(term) >= 4) SELECT prefix, count(*) AS n, min(term) AS first, max(term) AS last FROM p JOIN {_TERMS} t ON starts_with(t.term, p.prefix) GROUP BY prefix")
def prefix_join(spark, sf_dir):
    prefixes = _terms(spark, sf_dir, "benchmark").filter(F.length("term") >= 4).select(F.substring("term", 1, 4).alias("prefix")).distinct()
    return search.prefix_join(_terms(spark, sf_dir), prefixes, "term").groupBy("prefix").agg(F.count("*").alias("n"), F.min("term").alias("first"), F.max("term").alias("last"))


@query(f"SELECT term FROM {_TERMS} WHERE term >= 'th' AND term < 'ti'")
def range_scan(spark, sf_dir):
    return search.in_range(_terms(spark, sf_dir), "term", "th", "ti")


@query(f"WITH k AS (SELECT DISTINCT term AS entry FROM {_BENCH} WHERE length(term) <= 5), q AS (SELECT term FROM {_TERMS}) SELECT q.term AS term, max_by(entry, length(entry)) AS matched FROM q LEFT JOIN k ON starts_with(q.term, k.entry) GROUP BY q.term")
def longest_prefix(spark, sf_dir):
    keys = _terms(spark, sf_dir, "benchmark").filter(F.length("term") <= 5).select(F.col("term").alias("entry"))
    return search.longest_prefix(_terms(spark, sf_dir), keys, "term", "entry")


@query("SELECT a, b, levenshtein(a, b) AS distance FROM (SELECT DISTINCT p_type AS a FROM part), (SELECT DISTINCT replace(p_type, 'E', 'é') AS b FROM part) WHERE levenshtein(a, b) <= 3")
def fuzzy_lookup(spark, sf_dir):
    """Pairs within three byte edits; é is two bytes."""
    a = table(spark, sf_dir, "part").select(F.col("p_type").alias("a"))
    b = table(spark, sf_dir, "part").select(F.replace(F.col("p_type"), F.lit("E"), F.lit("é")).alias("b"))
    return search.fuzzy_join(a, b, "a", "b", 3)


@query(f"SELECT a.term AS a, b.term AS b, levenshtein(a.term, b.term) AS distance FROM {_BENCH} a, {_BENCH} b WHERE levenshtein(a.term, b.term) <= 2")
def fuzzy_terms(spark, sf_dir):
    """The benchmark's words within two byte edits of one another."""
    t = _terms(spark, sf_dir, "benchmark")
    return search.fuzzy_join(t.select(F.col("term").alias("a")), t.select(F.col("term").alias("b")), "a", "b", 2)


@query("WITH e AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS entry FROM benchmark), n AS (SELECT DISTINCT length(entry) AS n FROM e), t AS (SELECT page_id, html, n, unnest(range(1, length(html) - n + 2)) AS p FROM pages, n WHERE length(html) >= n), m AS (SELECT page_id, p, substr(html, p, n) AS s FROM t) SELECT page_id, entry, count(*) AS places, CAST(min(p) - 1 AS INTEGER) AS first FROM m JOIN e ON s = entry GROUP BY page_id, entry")
def multi_pattern(spark, sf_dir):
    """Places of every word of the benchmark in the pages, overlaps too: how many, and the first."""
    e = _terms(spark, sf_dir, "benchmark").select(F.col("term").alias("entry"))
    return search.multi_pattern_counts(table(spark, sf_dir, "pages"), e, "page_id", text="html")


@query("SELECT prefix, count(*) AS n FROM (SELECT unnest(list_transform(range(1, least(length(p_name), 12) + 1), lambda i: substr(p_name, 1, i))) AS prefix FROM part) GROUP BY prefix HAVING count(*) >= 20")
def common_prefixes(spark, sf_dir):
    return search.frequent_prefixes(table(spark, sf_dir, "part"), "p_name", 20, 12)


@query("WITH m AS (SELECT p_brand, min(p_type) AS a, max(p_type) AS b FROM part GROUP BY p_brand) SELECT p_brand, substr(a, 1, coalesce(list_max(list_filter(range(0, length(a) + 1), lambda i: substr(a, 1, i) = substr(b, 1, i))), 0)) AS prefix FROM m")
def set_common_prefix(spark, sf_dir):
    m = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_type").alias("a"), F.max("p_type").alias("b"))
    return m.select("p_brand", common_prefix(F.col("a"), F.col("b")).alias("prefix"))


@query("WITH k AS (SELECT DISTINCT o_custkey AS v FROM orders), t AS (SELECT DISTINCT c_custkey AS target FROM customer) SELECT target, (SELECT min(v) FROM k WHERE v >= target) AS lower, (SELECT min(v) FROM k WHERE v > target) AS upper FROM t")
def bounds(spark, sf_dir):
    """For each customer the first key of an order at or above, and above."""
    targets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target")).distinct()
    return sequence.lower_bound(table(spark, sf_dir, "orders"), targets, "o_custkey")


@query("WITH l AS (SELECT o_custkey AS g, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx FROM orders), t AS (SELECT o_custkey AS g, max(o_orderkey) // 2 AS target FROM orders GROUP BY 1) SELECT t.g AS g, target, min_by(idx, v) AS idx, min(v) AS next FROM t LEFT JOIN l ON l.g = t.g AND v >= target GROUP BY t.g, target")
def next_geq_asof(spark, sf_dir):
    """A forward as-of join in each customer's order keys."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("v"))
    t = o.groupBy("g").agg(F.floor(F.max("v") / 2).alias("target"))
    return sequence.next_geq(o, t, ["g"])


@query("WITH k AS (SELECT p_name FROM part), n AS (SELECT DISTINCT p_brand AS needle FROM part) SELECT needle, (SELECT count(*) FROM k WHERE p_name < needle) AS pos, EXISTS (SELECT 1 FROM k WHERE p_name = needle) AS found FROM n")
def insertion_point(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return search.insertion_point(p, p.select(F.col("p_brand").alias("needle")).distinct(), "p_name", "needle")


@query("WITH a AS (SELECT DISTINCT l_partkey AS v FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT p_partkey AS v FROM part WHERE p_size < 10) SELECT CAST((SELECT count(*) FROM (SELECT v FROM a INTERSECT SELECT v FROM b)) AS DOUBLE) / (SELECT count(*) FROM (SELECT v FROM a UNION SELECT v FROM b)) AS jaccard")
def jaccard_keys(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("v"))
    return stats.jaccard(a, table(spark, sf_dir, "part").filter("p_size < 10").select(F.col("p_partkey").alias("v")))


@query("SELECT p_partkey, CAST(strlen(p_name) AS INTEGER) AS size FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def exact_lookup(spark, sf_dir):
    """The first name in order, looked up."""
    p = table(spark, sf_dir, "part")
    first = p.agg(F.min("p_name").alias("p_name"))  # one row
    return p.join(F.broadcast(first), "p_name").select("p_partkey", F.length(as_bytes(F.col("p_name"))).alias("size"))


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def dimension_lookup(spark, sf_dir):
    """Hash lookups of keys; a missing key gives nulls. The planner broadcasts what it measures to be small."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(n, c["c_nationkey"] == n["n_nationkey"], "left").select("o_orderkey", "c_name", "n_name")


@query("SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS last_order, max_by(o_totalprice, o_orderkey) AS price FROM orders GROUP BY o_custkey")
def last_insert_wins(spark, sf_dir):
    """A keyed table in which the last insert of a key stays."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_order"), F.max_by("o_totalprice", "o_orderkey").alias("price"))

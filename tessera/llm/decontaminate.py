"""Benchmark decontamination by a distributed positional inverted index; built-in functions only.

1. Test items are cut into windows of consecutive words (a shorter item is one
   window); equal windows are one entry.
2. The corpus frequency of every test term is counted.
3. Each window is looked up by its rarest term, so only postings of those terms
   are stored: (term, document, position, the words around).
4. Postings meet the windows of their term and are moved by the term's offset
   in the window. The words around a posting are the other terms' postings next
   to it, so their lists, each moved by its own offset, are intersected with the
   rarest term's where it lies, the next rarest first, without a shuffle.
5. Proximity matches are pairs of postings of two terms of one document within
   a distance.

Terms are compared in lower case as a filter (cheap in the JVM) and by A-Z
lower case in the confirmation, which is the rule of the contract.

Edge cases: a null or empty text has no words and no hits; items without words,
and null items, are dropped; documents are told apart by id and text, so rows
with a repeated or null id get their own result each; repeated items count once
by their id. An empty corpus or an empty benchmark gives no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import EMPTY_SHA, ascii_lower, id_text, saved

#: A word of the lower-cased text, and the same word before A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_TERM = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"
#: Rows of benchmark windows up to which they are sent to all executors; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def raw_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RAW_TERM), F.lit(0))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, text): version tells apart rows with one id."""
    return id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("version"), "text")


def windows(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, window array<string>) of every item with words."""
    words = ascii_lower(F.coalesce(items[text_col].cast("string"), F.lit("")))
    rows = items.select(items[id_col].cast("string").alias("item_id"), F.regexp_extract_all(words, F.lit(TERM), F.lit(0)).alias("w"))
    rows = rows.filter(F.col("item_id").isNotNull() & (F.size("w") > 0))
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1))))
    return rows.withColumn("s", starts).select("item_id", F.slice("w", F.col("s"), width).alias("window")).distinct()


def sent(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to be small enough."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n) in the corpus of each row of terms (term); 0 where it never occurs."""
    seen = docs.select(F.explode_outer(raw_words(F.col("text"))).alias("word")).select(F.lower("word").alias("term"))
    counts = seen.join(sent(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def postings(docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """(term, doc_id, version, pos from 1, first, around): around are the words from place first, reach on either side."""
    words = docs.select("doc_id", "version", raw_words(F.col("text")).alias("words"))
    each = words.select("doc_id", "version", "words", F.posexplode_outer("words").alias("at", "word"))  # outer: else the words are made twice, for a filter on their number
    each = each.select("doc_id", "version", "words", (F.col("at") + 1).alias("pos"), F.lower("word").alias("term"))
    first = F.greatest(F.col("pos") - reach, F.lit(1))
    found = each.join(sent(terms.select("term")), "term")
    return found.select("term", "doc_id", "version", "pos", first.alias("first"), F.slice("words", first, F.col("pos") + reach + 1 - first).alias("around"))


def anchors(wins: DataFrame, freq: DataFrame) -> DataFrame:
    """(window, term, offset, next_term, next_offset): the two rarest terms of each distinct window."""
    each = wins.select("window").distinct().select("window", F.posexplode("window").alias("offset", "word"))
    each = each.withColumn("term", F.lower("word")).join(freq, "term")
    best = each.groupBy("window").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "term", "offset"))), 1, 2).alias("best"))
    last = F.element_at("best", -1)
    return best.select("window", F.col("best")[0]["term"].alias("term"), F.col("best")[0]["offset"].alias("offset"), last["term"].alias("next_term"), last["offset"].alias("next_offset"))


def phrase_matches(index: DataFrame, anchor: DataFrame) -> DataFrame:
    """(doc_id, version, start from 1, window): every exact occurrence of a window."""
    near = index.join(sent(anchor), "term").withColumn("start", F.col("pos") - F.col("offset")).withColumn("shift", F.col("start") - F.col("first"))
    near = near.filter((F.col("start") >= 1) & (F.col("shift") + F.size("window") <= F.size("around")))
    near = near.filter(F.lower(F.get("around", F.col("shift") + F.col("next_offset"))) == F.col("next_term"))
    text = F.slice("around", F.greatest(F.col("shift"), F.lit(0)) + 1, F.size("window"))  # filters may be tried in any order
    return near.filter(F.transform(text, ascii_lower) == F.col("window")).select("doc_id", "version", "start", "window").distinct()


def proximity_matches(index: DataFrame, pairs: DataFrame, distance: int) -> DataFrame:
    """(doc_id, version, term_a, term_b, pos_a, pos_b) of pairs (term_a, term_b) at most distance words apart.

    Places are dealt to cells of that width; a pair meets in its own cell or a neighbouring one.
    """
    a = index.join(sent(pairs), index["term"] == pairs["term_a"]).select("doc_id", "version", "term_a", "term_b", F.col("pos").alias("pos_a"))
    a = a.withColumn("cell", F.explode(F.array(*[F.floor(F.col("pos_a") / distance) + i for i in (-1, 0, 1)])))
    b = index.select("doc_id", "version", F.col("term").alias("term_b"), F.col("pos").alias("pos_b"), F.floor(F.col("pos") / distance).alias("cell"))
    both = a.join(b, (a["doc_id"].eqNullSafe(b["doc_id"])) & (a["version"] == b["version"]) & (a["term_b"] == b["term_b"]) & (a["cell"] == b["cell"]))
    both = both.filter(F.abs(F.col("pos_a") - F.col("pos_b")) <= distance)
    return both.select(a["doc_id"], a["version"], "term_a", a["term_b"], "pos_a", "pos_b")


def near_pairs(index: DataFrame, anchor: DataFrame) -> DataFrame:
    """(doc_id, version, n_near): places of a window's rarest term with its next rarest one among the words around.

    Proximity within the reach of the postings, whose words around are the other lists next to them.
    """
    pairs = anchor.filter("term <> next_term").select("term", "next_term").distinct()
    near = index.join(sent(pairs), "term").filter(F.array_contains(F.transform("around", F.lower), F.col("next_term")))
    return near.groupBy("doc_id", "version").agg(F.count_distinct("pos", "term", "next_term").alias("n_near"))


def matches(docs: DataFrame, items: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrase matches, windows by item, near_pairs) of documents(docs)."""
    wins = saved(windows(items, width), "windows")
    terms = wins.select(F.explode("window").alias("w")).select(F.lower("w").alias("term")).distinct()
    anchor = saved(anchors(wins, frequencies(docs, terms)), "anchors")
    index = saved(postings(docs, anchor.select("term").distinct(), width - 1), "postings")
    return phrase_matches(index, anchor), wins, near_pairs(index, anchor)


def hits(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version) of documents(docs) with any window."""
    return matches(documents(docs, id_col, text_col), items, width)[0].select("doc_id", "version").distinct()


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near) of every row."""
    rows = documents(docs, id_col, text_col)
    found, wins, near = matches(rows, items, width)
    found = saved(found, "matches")
    key = ["doc_id", "version"]
    # a window per start reaches as far as the longest match there; words hit are counted by what each start adds to those before
    reach = found.groupBy(*key, "start").agg(F.max(F.col("start") + F.size("window")).alias("stop"))
    spans = reach.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["stop"] - F.greatest(x["start"].cast("long"), acc["to"]), F.lit(0))).alias("n"),
            F.greatest(acc["to"], x["stop"].cast("long")).alias("to"),
        ),
    )
    hit = spans.select(*key, covered["n"].alias("n_hit"))
    of_items = found.join(sent(wins), "window").groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    of_items = of_items.select(*key, F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    hits = hit.join(of_items, hit["doc_id"].eqNullSafe(of_items["doc_id"]) & (hit["version"] == of_items["version"])).select(
        hit["doc_id"].alias("hit_id"), hit["version"].alias("hit_version"), "n_hit", "n_items", "items_sha256"
    )
    near = near.select(F.col("doc_id").alias("near_id"), F.col("version").alias("near_version"), "n_near")
    sizes = rows.select(*key, F.regexp_count("text", F.lit(RAW_TERM)).cast("long").alias("n_words"))
    all_rows = sizes.join(hits, sizes["doc_id"].eqNullSafe(hits["hit_id"]) & (sizes["version"] == hits["hit_version"]), "left")
    all_rows = all_rows.join(near, sizes["doc_id"].eqNullSafe(near["near_id"]) & (sizes["version"] == near["near_version"]), "left")
    zero = F.lit(0).cast("long")
    return all_rows.select(
        "doc_id", F.coalesce("n_words", zero).alias("n_words"), F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.lit(EMPTY_SHA)).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
        F.coalesce("n_near", zero).alias("n_near"),
    )


#: The contract in DuckDB's SQL: every window of every document against every window of an item.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[s : s + 9], ' ') AS win FROM bs),
dl AS (SELECT doc_id, w, l FROM d CROSS JOIN (SELECT DISTINCT l FROM bw) WHERE len(w) >= l),
ds AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM dl),
dw AS (SELECT doc_id, l, s, array_to_string(w[s : s + l - 1], ' ') AS win FROM ds),
h AS (SELECT doc_id, s, dw.l AS l, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.l = bw.l),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id),
bt AS (SELECT win, lower(unnest(win)) AS term, unnest(range(0, len(win))) AS off FROM (SELECT DISTINCT w[s : s + 9] AS win FROM bs)),
dp AS (SELECT doc_id, lower(unnest(w)) AS term, unnest(range(1, len(w) + 1)) AS p FROM d),
fr AS (SELECT term, count(*) AS n FROM dp GROUP BY term),
rk AS (SELECT win, bt.term AS term, row_number() OVER (PARTITION BY win ORDER BY coalesce(n, 0), bt.term, off) AS r FROM bt LEFT JOIN fr ON bt.term = fr.term),
pr AS (SELECT DISTINCT a.term AS t1, b.term AS t2 FROM rk a JOIN rk b ON a.win = b.win AND a.r = 1 AND b.r = 2 WHERE a.term <> b.term),
nn AS (SELECT doc_id, count(*) AS n_near FROM (SELECT DISTINCT x.doc_id AS doc_id, x.p AS p, t1, t2 FROM dp x JOIN pr ON x.term = t1 JOIN dp y ON y.doc_id = x.doc_id AND y.term = t2 AND abs(y.p - x.p) <= 9) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       coalesce(i.sha, sha256('')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN nn USING (doc_id)
"""

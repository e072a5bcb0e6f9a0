"""MinHash near-duplicate documents: one-permutation sketches, banded buckets, star edges, exact confirmation.

A document's set holds its distinct word shingles (a text of fewer words is one
shingle). Documents with equal sets are one element from the start, whatever
their number; elements are linked as in ``lsh``. With 32 bands of 4 places two
sets of similarity 0.85 share no band with probability 6e-11, of 0.8 with 4e-8.

Edge cases: a null or empty text, or one of white space, has an empty set and is
linked with nothing; of rows with one id and different texts each has the
component of its own text; rows with a null id take no part (component null,
kept); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import lsh, repeats
from tessera.llm.common import each_row, id_text, saved
from tessera.llm.hashing import distinct, mixed, strings
from tessera.llm.words import word_hashes

U = np.uint64
#: Fixed value: ASCII white space.
_SPACE = b" \t\n\v\f\r"
ROWS, BANDS = 4, 32


def shingles(texts: list[str], width: int, sets: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all texts; how many each has); distinct and sorted within a text if sets."""
    h, sizes = word_hashes(texts, _SPACE, True)
    key = mixed(strings(h, width)) if len(h) >= width else np.empty(0, U)
    ends = np.cumsum(sizes)
    parts = []
    for i, j in zip((ends - sizes).tolist(), ends.tolist()):
        if j - i >= width:
            parts.append(distinct(key[i : j - width + 1]) if sets else key[i : j - width + 1])
        elif j > i:  # the whole sequence
            parts.append(mixed(strings(h[i:j], j - i) + U(j - i)))
        else:
            parts.append(h[:0])
    return np.concatenate(parts) if parts else np.empty(0, U), np.array([len(p) for p in parts], np.int64)


def sets(width: int, percent: int) -> lsh.Sets:
    """Links where 100 * intersection >= percent * union."""
    return lsh.Sets(lambda t: shingles(t, width, True), lambda t: shingles(t, width, False), percent, ROWS, BANDS)


def components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, n_shingles, component_id, kept) of every row; version: the xxhash64 of the text."""
    rule = sets(width, percent)
    rows = id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("version"), "text")

    def measure(texts: list[str]) -> dict[str, list]:
        keys, sizes = shingles(texts, width, True)
        ends = np.cumsum(sizes)
        return {"n_shingles": sizes, "print": [hashlib.blake2b(keys[i:j].tobytes(), digest_size=16).digest() for i, j in zip(ends - sizes, ends)]}

    base = saved(each_row(rows, measure, "n_shingles long, print binary", chars=1_000_000), "measures")
    nr = F.expr("cast(version & 2147483647 as int)")
    live = base.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).select(F.col("doc_id").alias("doc"), nr.alias("nr"), "print").distinct()
    some = rows.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    elements = some.select(F.col("doc_id").alias("doc"), nr.alias("nr"), "text")
    e = ["doc", "nr"]

    def texts_of(nodes: DataFrame) -> DataFrame:
        near = repeats.filtered(elements, nodes, "doc")
        return near.join(nodes.hint("merge"), e, "left_semi").dropDuplicates(e)

    bits = lsh.buckets(base.count() * BANDS)
    found = lsh.met(lsh.requests(elements, rule, bits), min(1 << bits, repeats.PARTITIONS))
    star = saved(found.select(*lsh.A, *lsh.B).distinct(), "stars")
    roots = lsh.linked(star, rule, texts_of)
    # every class of equal sets hangs together: its least member stands for it, and edges join what its members have
    classes = live.groupBy("print").agg(F.min(F.struct(*e)).alias("least"))
    edges = live.join(roots, e).join(classes, "print").select(F.col("root").alias("a"), F.col("least").alias("b"))
    top = lsh.components(edges)
    label = classes.join(top.withColumnRenamed("node", "least"), "least", "left").select(F.col("print").alias("of_print"), F.coalesce("root.doc", "least.doc").alias("component"))
    out = base.join(label, base["print"] == label["of_print"], "left")
    taking_part = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(taking_part, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "version", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


#: The contract in DuckDB's SQL: all documents by shared shingles.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM m JOIN n nx ON m.x = nx.doc_id JOIN n ny ON m.y = ny.doc_id WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
r AS (SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT e.y AS x, r.root AS root FROM r JOIN e ON e.x = r.x WHERE r.root < e.y),
c AS (SELECT x, min(root) AS component_id FROM r GROUP BY x)
SELECT w.doc_id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id AS component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN c ON w.doc_id = c.x
"""

"""Exact top-k search by inner product: a Voronoi kNN join.

1. A bounded sample of the vectors gives pivots, about the square root of the
   table's rows and no more than the sample. Every vector goes to the cell of its
   nearest pivot (Euclidean); a cell's summary is its number of vectors and its
   radius.
2. For a query q the scores of a cell with pivot p and radius r lie within
   q.p - |q| r and q.p + |q| r. The k-th best lower bound over the cells, and the
   k-th best score among the sample, are both scores that q's k-th neighbour at
   least reaches; cells whose upper bound is below that are left out, and q is
   replicated only to the rest.
3. Cells are split into blocks of bounded size, so a frequent vector does not
   make a large task. Blocks are solved locally; each query keeps at most k
   candidates per block, and the best k of those are the answer.

Components are floor(scale * x) as integers, so scores are exact.

Edge cases: vectors that are null, empty or hold null or non-finite components,
and rows with a null id, take no part; vectors of different lengths are not
compared; rows that repeat an id are all candidates of other ids' queries and
never of their own, and a repeated query (same id and vector) is asked once;
ties go to the smaller id; with fewer candidates all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import saved

#: Vectors in the sample, pivots at least, vectors of a block, and rows whose distances to all pivots are held at once.
SAMPLE, PIVOTS, BLOCK, ROWS = 4096, 128, 4096, 1024
#: Slack for rounding in the bounds, which are floats; scores are integers.
SLACK = 1e-6


def integer_vectors(vectors: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<bigint>) of the rows that take part."""
    x = vectors[vector_col].cast("array<double>")
    good = vectors[id_col].isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(good).select(vectors[id_col].cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of a and b."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    raise OverflowError("scores of these vectors do not fit into 64 bits")


def _by_length(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    n = pdf["v"].str.len()
    for size in n.unique():
        yield pdf[n == size]


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score). Both inputs: (vec_id, v array<bigint>) as of integer_vectors."""
    spark = vectors.sparkSession
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).toPandas()
    pivots_ = max(PIVOTS, math.isqrt(vectors.count())) if len(sample) == SAMPLE else PIVOTS
    held = {}
    for part in _by_length(sample) if len(sample) else ():
        m = _matrix(part["v"])
        held[m.shape[1]] = (part["vec_id"].to_numpy(np.int64), m, np.unique(m[:pivots_], axis=0).astype(np.float64))
    shared = spark.sparkContext.broadcast(held)

    def nearest(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if m.shape[1] not in shared.value:  # a length the sample missed: one cell around the origin
            return np.zeros(len(m), np.int64), np.linalg.norm(m.astype(np.float64), axis=1)
        pivots = shared.value[m.shape[1]][2]
        x, size = m.astype(np.float64), (pivots**2).sum(1)
        cell = np.concatenate([(size - 2 * x[lo : lo + ROWS] @ pivots.T).argmin(axis=1) for lo in range(0, len(x), ROWS)])
        return cell, np.linalg.norm(x - pivots[cell], axis=1)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part in _by_length(pdf):
                m = _matrix(part["v"])
                cell, r = nearest(m)
                yield pd.DataFrame({"size": m.shape[1], "cell": cell, "vec_id": part["vec_id"].to_numpy(), "r": r, "v": [x.tobytes() for x in m]})

    placed = saved(vectors.mapInPandas(assign, "size int, cell int, vec_id long, r double, v binary"), "cells")
    # one row per pivot and length: bounded by the sample
    summary = placed.groupBy("size", "cell").agg(F.count("*").alias("n"), F.max("r").alias("r"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).toPandas()
    cells = spark.sparkContext.broadcast({int(s): p[["cell", "n", "r", "blocks"]].to_numpy(np.float64) for s, p in summary.groupby("size")})

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part in (p.iloc[lo : lo + ROWS] for p in _by_length(pdf) for lo in range(0, len(p), ROWS)):
                m, ids, mark, own = _matrix(part["v"]), *(part[c].to_numpy(np.int64) for c in ("vec_id", "mark", "own"))
                about = cells.value.get(m.shape[1])
                if about is None:
                    continue
                cell, n, r, blocks = about[:, 0].astype(int), about[:, 1], about[:, 2], about[:, 3].astype(int)
                norm = np.linalg.norm(m.astype(np.float64), axis=1)[:, None]
                known = shared.value.get(m.shape[1])
                middle = m.astype(np.float64) @ (known[2][cell] if known else np.zeros((len(cell), m.shape[1]))).T
                slack = SLACK * (1 + np.abs(middle) + norm * r)
                low, high = middle - norm * r - slack, middle + norm * r + slack
                order = np.argsort(-low, axis=1)
                enough = np.cumsum(n[order], axis=1) >= k + own[:, None]  # rows of the query's id are none of its answers
                at = enough.argmax(axis=1)
                least = np.where(enough[:, -1], np.take_along_axis(low, order, 1)[np.arange(len(m)), at], -np.inf)
                if known and len(known[0]) > k:
                    score = product(m, known[1]).astype(np.float64)
                    score[ids[:, None] == known[0]] = -np.inf
                    least = np.maximum(least, -np.partition(-score, k - 1, axis=1)[:, k - 1])
                q, c = np.nonzero(high >= least[:, None])
                times = blocks[c]
                block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                q, c = np.repeat(q, times), np.repeat(c, times)
                for lo in range(0, len(q), 20_000):
                    i, j = q[lo : lo + 20_000], c[lo : lo + 20_000]
                    yield pd.DataFrame({"size": m.shape[1], "cell": cell[j], "block": block[lo : lo + 20_000], "side": 1, "vec_id": ids[i], "mark": mark[i], "least": np.maximum(least[i], -(2.0**62)), "v": [m[x].tobytes() for x in i]})

    schema = "size int, cell int, block int, side int, vec_id long, mark long, least double, v binary"
    times = vectors.groupBy("vec_id").agg(F.count("*").alias("own"))
    asked = queries.dropDuplicates(["vec_id", "v"]).withColumn("mark", F.xxhash64("v")).join(times, "vec_id", "left")  # mark: the vector of a repeated id
    asked = asked.withColumn("own", F.coalesce("own", F.lit(0))).mapInPandas(reach, schema)
    counts = F.broadcast(spark.createDataFrame(summary[["size", "cell", "blocks"]].astype(int), "size int, cell int, blocks int")) if len(summary) else None
    if counts is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    data = placed.join(counts, ["size", "cell"]).select("size", "cell", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), "vec_id", F.lit(0).cast("long").alias("mark"), F.lit(0.0).alias("least"), "v")

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, ids, known, part = None, [], [], None
        for pdf in frames:
            key = pdf["size"].astype("int64").to_numpy() * (1 << 40) + pdf["cell"].to_numpy() * (1 << 24) + pdf["block"].to_numpy()
            edges = np.flatnonzero(np.diff(key * 2 + pdf["side"].to_numpy())) + 1
            for i, j in zip([0, *edges], [*edges, len(pdf)]):
                rows = pdf.iloc[i:j]
                if key[i] != group:
                    group, ids, known, part = key[i], [], [], None
                m = np.frombuffer(b"".join(rows["v"]), np.int64).reshape(len(rows), -1)
                if rows["side"].iat[0] == 0:
                    ids.append(rows["vec_id"].to_numpy())
                    known.append(m)
                    continue
                if not ids:
                    continue
                if part is None:
                    names, part = np.concatenate(ids), np.concatenate(known)
                    order = np.argsort(names, kind="stable")
                    names, part = names[order], part[order]
                for lo in range(0, len(m), 512):
                    who, mark, least = (rows[c].to_numpy()[lo : lo + 512] for c in ("vec_id", "mark", "least"))
                    score = product(m[lo : lo + 512], part)
                    a, b = np.nonzero((score >= least[:, None]) & (names != who[:, None]))
                    found = score[a, b]
                    order = np.lexsort((b, -found, a))  # ids ascend with b, so ties go to the smaller
                    a, b, found = a[order], b[order], found[order]
                    first = np.searchsorted(a, np.arange(len(who)))
                    keep = np.arange(len(a)) - first[a] < k
                    a, b, found = a[keep], b[keep], found[keep]
                    if len(a):
                        yield pd.DataFrame({"query_id": who[a], "mark": mark[a], "vec_id": names[b], "score": found})

    rows = data.union(asked).repartition("size", "cell", "block").sortWithinPartitions("size", "cell", "block", "side")
    found = rows.mapInPandas(solve, "query_id long, mark long, vec_id long, score long")
    best = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The contract in DuckDB's SQL.
SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
u AS (SELECT vec_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM e),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM u q JOIN u c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id, c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

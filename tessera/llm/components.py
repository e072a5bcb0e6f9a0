"""Connected components: union-find in partitions of bounded size, and stars between them.

Edges are dealt to partitions of at most LOCAL edges, and each is contracted on
its own: every node of it points to the least node it hangs together with. With
one partition that is the answer. With more, contraction alternates with a large
and a small star (two aggregations and two joins, without gathering a node's
neighbours) until a round changes nothing. No edge leaves the executors.

Nodes are integers, or structs of integers compared field by field.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import dropped, saved

#: Edges that one task holds: about 100 bytes each.
LOCAL = 1_000_000


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component; edges a-b between nodes 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """(u, v) with v the least node of u's component among the edges of a partition; u > v."""
    kind = edges.schema["u"].dataType
    fields = kind.names if isinstance(kind, StructType) else []
    flat = [F.col(f"{c}.{f}").cast("long").alias(f"{c}{i}") for c in "uv" for i, f in enumerate(fields)] or [F.col("u").cast("long").alias("u0"), F.col("v").cast("long").alias("v0")]
    width = max(len(fields), 1)
    names = [f"{c}{i}" for c in "uv" for i in range(width)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf.to_numpy(np.int64) for pdf in frames]
        if not held:
            return
        pairs = np.concatenate(held)
        nodes, code = np.unique(np.concatenate([pairs[:, :width], pairs[:, width:]]), axis=0, return_inverse=True)
        code = code.ravel()
        root = roots_of(code[: len(pairs)], code[len(pairs) :], len(nodes))
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        yield pd.DataFrame(np.concatenate([nodes[moved], nodes[root[moved]]], axis=1), columns=names)

    rows = edges.select(*flat)
    rows = rows.repartition(1) if parts == 1 else rows.repartition(parts, *names[:width])
    out = rows.mapInPandas(run, ", ".join(f"{n} long" for n in names))
    if not fields:
        return out.select(F.col("u0").cast(kind).alias("u"), F.col("v0").cast(kind).alias("v"))
    return out.select(*[F.struct(*[F.col(f"{c}{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(kind.fields)]).alias(c) for c in "uv"])


def _large(edges: DataFrame) -> DataFrame:
    """Every node's greater neighbours move to the least node of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node's lesser neighbours and itself move to the least of them. edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    rest = moved.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, root) of every node that has an edge (a, b); root is the least node of its component.

    Loops and repeated edges do no harm; no edges give no rows.
    """
    now = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    done: list[str] = []
    spark = edges.sparkSession

    def step(df: DataFrame, name: str) -> DataFrame:
        """Writes df and removes the table before."""
        before = list(done)
        done.clear()
        out = saved(df, name, into=done)
        dropped(spark, before)
        return out

    now = step(now, "edges")
    state = _state(now)
    while state[0]:
        parts = -(-state[0] // local)
        now = step(_contracted(now, parts), "contracted")
        if parts == 1:
            break
        now = step(_small(_large(now)), "stars")
        after = _state(now)
        if after == state:
            break
        state = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Walks over edge tables (src, dst), level by level on written frontiers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.store import shared_dir


def _kept(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/tessera-{uuid.uuid4().hex}/walk"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def levels(edges: DataFrame, seeds: DataFrame, max_depth: int, keep_vertex=None, keep_edge=None) -> DataFrame:
    """(v, depth) reached from seeds (v) by breadth-first walk; depth runs below max_depth.

    keep_vertex: a condition on v; what fails is visited but not walked from. keep_edge: a condition on src, dst.
    A level is one join with the edges and one anti join with what was seen.
    """
    if keep_edge is not None:
        edges = edges.filter(keep_edge)
    seen = _kept(seeds.select("v").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for depth in range(1, max_depth):
        start = front if keep_vertex is None else front.filter(keep_vertex)
        new = start.join(edges, start["v"] == edges["src"]).select(F.col("dst").alias("v")).distinct().join(seen, "v", "left_anti")
        front = _kept(new.withColumn("depth", F.lit(depth)))
        if not front.limit(1).count():
            break
        seen = seen.union(front)
    return seen


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int = 1000) -> DataFrame:
    return levels(edges, seeds, max_depth).select("v")


def depth_first(edges: DataFrame, seeds: DataFrame, by: str) -> DataFrame:
    """(by, v, nr): vertices in depth-first order, least neighbours first, of each small graph that by names.

    edges: (by, src, dst), seeds: (by, v). The order is sequential by nature, so a graph is walked in one task.
    """
    import pandas as pd

    def walk(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict = {}
        for s, d in sorted(zip(left["src"], left["dst"])):
            out.setdefault(s, []).append(d)
        stack, seen, order = sorted(right["v"], reverse=True), set(), []
        while stack:
            v = stack.pop()
            if v in seen:
                continue
            seen.add(v)
            order.append(v)
            stack.extend(d for d in reversed(out.get(v, [])) if d not in seen)
        return pd.DataFrame({by: [key[0]] * len(order), "v": order, "nr": range(len(order))})

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    return edges.groupBy(by).cogroup(seeds.groupBy(by)).applyInPandas(walk, f"{by} {kinds[by]}, v {kinds['src']}, nr int")

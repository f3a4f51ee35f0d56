"""Connected components: by forests of partitions, then at once while they are few, else by stars that grow and shrink."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Edges that one task takes at most; more of them are joined by stars, each step written before the next reads it.
AT_ONCE = 1 << 19


def forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a partition's edges, one from each vertex to the smallest that they join it with."""
    up: dict[int, int] = {}

    def top(v: int) -> int:
        root = v
        while (n := up.get(root, root)) != root:
            root = n
        while v != root:
            up[v], v = root, up.get(v, v)
        return root

    for part in parts:
        for a, b in zip(part["a"].tolist(), part["b"].tolist(), strict=True):
            x, y = top(a), top(b)
            up.setdefault(a, a)
            up.setdefault(b, b)
            if x != y:
                up[max(x, y)] = min(x, y)
    pairs = np.array([(v, top(v)) for v in up], np.int64).reshape(-1, 2)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs to (v, root): root is the smallest vertex that v reaches; vertices that are roots are left out.

    Edges are reduced to a forest in each partition. AT_ONCE of them or less, counted, are joined by one task. Beyond, a vertex
    with very many edges costs no more than its edges: its minimum is combined before the shuffle, and the join that hands the
    minimum on is one that Spark can split. No edges, no rows. Loops and repeated edges change nothing.
    """
    now = written(edges.select("a", "b").where("a <> b").mapInPandas(forest, "a long, b long"), "cc")
    if now.count() <= AT_ONCE:
        last = written(now.coalesce(1).mapInPandas(forest, "a long, b long"), "cc")
        discard(now)
        return named(last)
    seen = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        last, now = now, written(small, "cc")
        discard(last)
        sign = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sign == seen:
            return named(now)
        seen = sign


def named(edges: DataFrame) -> DataFrame:
    out = edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out._drop = edges._drop
    return out

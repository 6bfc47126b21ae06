"""Connected components of a graph in Spark, by alternating large-star and small-star steps.

Before the steps, edges are dealt out in parts of bounded size, of which each keeps a spanning forest: a dense
group, whose edges are many times its nodes, comes down to few edges a node, and no component changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import materialize


#: Edges of a part that one task holds.
PART_EDGES = 400_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges that join two trees of those before, by union-find."""
    up: dict = {}

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for batch in batches:
        keep = []
        for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            a, b = top(a), top(b)
            if a != b:
                up[a] = b
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step: every node moves towards the smallest node near it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return small.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_steps: int = 50) -> DataFrame:
    """(node, root) for every node of edges (a, b, of one type); root is the smallest node it reaches.

    Edges with a null end are ignored; nodes without edges are not returned.
    """
    now = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    parts = max(8, -(-now.count() // PART_EDGES))
    now = materialize(now.repartition(parts).mapInArrow(_forest, now.schema), "edges")
    state = None
    for _ in range(max_steps):
        now = materialize(_star(now), "edges")
        new = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if new == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = new
    raise RuntimeError("components did not settle")

"""Connected components of an edge table, by rounds of star contraction on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takemark.llm.common import Scratch


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition as stars: each node with the smallest node that these edges connect it to."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    if parent:
        nodes = [*parent]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([root(x) for x in nodes])], ["node", "low"])


def _lowered(edges: DataFrame, larger_only: bool, s: Scratch) -> DataFrame:
    """One star step: every node links its neighbours (only the larger ones, or else the smaller ones and itself) to its smallest."""
    if larger_only:
        both = edges.unionByName(edges.select(F.col("low").alias("node"), F.col("node").alias("low")))
    else:
        both = edges
    both = s.saved(both.where("node <> low"), "star")
    least = s.saved(both.groupBy("node").agg(F.min("low").alias("m")).select(F.col("node").alias("at"), F.least("m", "node").alias("m")), "least")
    joined = both.join(least, F.col("node") == F.col("at"))
    if larger_only:
        return joined.where("low > node").select(F.col("low").alias("node"), F.col("m").alias("low")).distinct()
    return joined.select(F.col("low").alias("node"), F.col("m").alias("low")).union(least.select("at", "m")).where("node <> low").distinct()


def connected_components(edges: DataFrame, s: Scratch, rows_per_task: int = 200_000) -> DataFrame:
    """(node, component): the smallest node that each node of edges (node, low) reaches; a table of s.

    Tasks first reduce bounded shares of the edges to forests; if there were several,
    large-star and small-star rounds follow until no edge changes. Null edges are ignored.
    """
    edges = s.saved(edges.where("node is not null and low is not null").distinct(), "edges")
    tasks = max(1, -(-edges.count() // rows_per_task))
    stars = s.saved(edges.repartition(tasks).mapInArrow(_forest, "node long, low long"), "forest")
    mark = None
    while tasks > 1:
        with Scratch(s.spark) as turn:
            # Always "node > low" from here on.
            large = turn.saved(_lowered(stars.where("node <> low"), True, turn), "large")
            stars = s.saved(_lowered(large, False, turn), "small")
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "low").cast("decimal(38,0)"))).first()
        if now == mark:
            stars = stars.unionByName(stars.select(F.col("low").alias("node"), "low"))
            break
        mark = now
    return s.saved(stars.groupBy("node").agg(F.min("low").alias("component")), "components")

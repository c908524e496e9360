"""Connected components of a table of links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: links that one task may hold
FEW = 100_000


def _joined(batches):
    """Union-find over all links of the task: every node with the smallest of its component."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(parent), pa.int64()), pa.array(map(root, list(parent)), pa.int64())],
        names=["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link in (a, b); a component is its smallest node.

    At most ``FEW`` links are joined in one task. More are contracted by large-star and small-star
    steps: neighbours point at the smallest one they know of, until nothing changes; the number of
    steps grows with the logarithm of the longest path. Every step is a written table. Minima are
    combined before the shuffle, so a node with very many links is no hot group.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"),
                                                 F.least("a", "b").alias("b")).distinct(), "links")
    if edges.count() <= FEW:
        return edges.coalesce(1).mapInArrow(_joined, "node long, component long")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = stored(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "small-star")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

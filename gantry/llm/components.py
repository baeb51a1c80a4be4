"""Connected components of an edge table, by alternating stars.

Each round joins every node's larger neighbours, then its smaller ones, to the smallest node it knows (large and small
star); edges end up pointing from every node to the smallest of its component after about log(n)
rounds.  Tasks first replace the edges they hold by a spanning forest.  Every star is
written to the shared folder, and deleted once the next one is; no edges reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import discarded, written


class Forest:
    """Union by smallest number."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        path = []
        while (up := parent.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            parent[p] = x
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def edges(self) -> tuple[list[int], list[int]]:
        nodes = list(self.parent)
        return nodes, [self.root(x) for x in nodes]


MAX_NODES = 500_000


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()

    def out() -> pa.RecordBatch:
        nodes, roots = forest.edges()
        return pa.RecordBatch.from_pydict({"a": pa.array(nodes, pa.int64()), "b": pa.array(roots, pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.parent) > MAX_NODES:
            yield out()
            forest = Forest()
    yield out()


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    if larger:  # neighbours above a join the least
        joined = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # edges go from the larger to the smaller end: all below a, and a itself, join the least
        joined = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        joined = joined.unionByName(least.select("a", F.col("m").alias("b")))
    return joined.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges`` (longs ``a, b``) that isn't its component's smallest."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    edges = written(edges.mapInArrow(_forests, "a long, b long").distinct(), "forest")
    before = None
    while True:
        for larger in (True, False):
            star = written(_star(edges, larger), "star")  # each star reads its edges three times
            discarded(edges)
            edges = star
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now

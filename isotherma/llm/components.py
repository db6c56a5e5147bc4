"""Connected components of an edge table: union-find within each partition, then star contraction across partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def forest(pairs: list[tuple]) -> list[tuple]:
    """Union-find: (member, smallest member) for every member that isn't the smallest of its component."""
    parent: dict = {}

    def root(x):
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in parent if root(x) != x]


def _local(edges: DataFrame) -> DataFrame:
    """Replace the edges of each batch of a partition by its forest; keeps what is connected and never adds edges."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = forest(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, batch.schema.types[0]), pa.array(b, batch.schema.types[0])], names=["a", "b"])

    return edges.mapInArrow(work, edges.schema)


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("_m"))
    joined = large.join(low, "a")
    return joined.select("a", F.col("_m").alias("b")).union(joined.where("b != _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of comparable values -> (a, b) where b is the smallest member of a's component, for all a but the smallest.

    Self-loops and repeated edges do no harm; NULLs must not occur. Each round is written to the shared folder; the number of rounds grows
    with the logarithm of the longest path. Hubs are joined on a key that one side holds once, which adaptive execution splits.
    """
    ordered = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stored(_local(ordered).distinct(), "components")
    mark = _mark(now)
    while mark[0]:
        now = stored(_star(now), "components")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("b", "a").cast("long"))).first())

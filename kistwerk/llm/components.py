"""Connected components of links that stay distributed: alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A star for every component of the task's own links."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up.get(top, top) != top:
            top = up[top]
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            r, s = root(u), root(v)
            if r != s:
                up[max(r, s)] = min(r, s)
    pairs = [(x, root(x)) for x in list(up)]
    pairs = [(x, r) for x, r in pairs if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])


#: Links that one task contracts.
CONTRACTED = 500_000


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(u, v)``, longs; component is the smallest node of its component.

    Links may repeat, be given in either direction or loop (a node with loops only gets no row). Tasks first
    replace up to CONTRACTED links each by stars. If one task held them all, these are the components. Otherwise each round takes every node's smallest
    neighbour (an aggregate with a map-side part) and hangs its other neighbours below it, until nothing changes.
    A node with very many neighbours is met by a join, which adaptive execution splits. ``links`` should be written, it is read twice.
    """
    proper = links.where("u <> v").select("u", "v")
    chunks = max(1, -(-proper.count() // CONTRACTED))
    edges = written(proper.repartition(chunks).mapInArrow(_forest, "u long, v long"), "links")
    before = None
    while chunks > 1:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # now u > v everywhere
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(hung.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))

"""Embedding near-dedup by Euclidean p-stable hashing.

A normalised vector x falls, in each of L tables, into the bucket of floor((a.x + b) / WIDTH) for m Gaussian
projections a. Vectors of cosine c are sqrt(2 - 2c) apart; m grows with the logarithm of the number of vectors, so
that about FILL unrelated vectors share a bucket, and L follows from m so that a pair at the threshold is missed in all
tables with probability MISS at most. Pairs that share a bucket are checked by their cosine in double precision, all pairs
of a bucket by one product of matrices; longer keys would make buckets smaller, but need more tables, in each of which every vector travels.

Equal vectors are one node with a count. A bucket of more than BLOCK nodes is dealt out as pairs of blocks. A link
that several tables find is counted by the first of them alone: the task recomputes the earlier
tables' keys of the two vectors, with numbers rounded so that every sum is exact in doubles, whatever its order.
Links are never written one by one: a task gives for each of its nodes the number of new links, and a spanning forest of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, written
from .components import connected_components

WIDTH, MISS, BLOCK, FILL = 2.0, 0.002, 512, 256


def collision(distance: float) -> float:
    """The probability that one projection puts two vectors at this distance into one interval."""
    r = WIDTH / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float) -> tuple[int, int]:
    """(m, L) for n vectors."""
    m = max(4, math.ceil(math.log((n + 1) / FILL) / -math.log(collision(1.3))))  # unrelated vectors are about sqrt(2) apart
    p = collision(math.sqrt(max(2 - 2 * threshold, 1e-4))) ** m
    return m, max(1, math.ceil(math.log(MISS) / math.log1p(-p)))


@lru_cache(maxsize=4)
def _projections(dim: int, m: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([2, dim, m])
    a = np.round(rng.normal(size=(dim, m * tables)) * 2**14) / 2**14
    return a, rng.random(m * tables) * WIDTH, rng.integers(0, 2**63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def keys(x: np.ndarray, m: int, tables: int, first: int | None = None) -> np.ndarray:
    """Bucket keys (vectors, tables) of unit vectors, of the ``first`` tables only if given; exact sums, so that any grouping of rows gives the same."""
    a, b, odd = _projections(x.shape[1], m, tables)
    n = tables if first is None else first
    q = np.floor((np.round(x * 2**20) / 2**20 @ a[:, : n * m] + b[: n * m]) / WIDTH).astype(np.int64).astype(np.uint64)
    h = (q.reshape(len(x), n, m) * odd).sum(axis=2)
    return mix(h + np.arange(n, dtype=np.uint64) * odd[0] + np.uint64(x.shape[1])).view(np.int64)


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Numbers of links (u, v) between n nodes that join the same nodes as all of them, fewer than n."""
    label, kept = np.arange(n), []
    while True:
        a, b = label[u], label[v]
        open_ = np.flatnonzero(a != b)
        if not len(open_):
            return np.concatenate(kept) if kept else open_
        lo, hi = np.minimum(a, b)[open_], np.maximum(a, b)[open_]
        top, one = np.unique(hi, return_index=True)
        kept.append(open_[one])
        up = np.arange(n)
        up[top] = lo[one]
        while not np.array_equal(up, up[up]):
            up = up[up]
        label = up[label]


def _matrix(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) for each dimension that occurs."""
    off = np.asarray(col.offsets)
    flat = col.values.to_numpy(zero_copy_only=False)
    size = np.diff(off)
    return [(at, flat[off[at][:, None] + np.arange(d)]) for d in np.unique(size) for at in [np.flatnonzero(size == d)]]


def _hash(m: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                for at, raw in _matrix(part.column(1)):
                    k = keys(unit(raw), m, tables)
                    ids = part.column(0).to_numpy()[at]
                    cols = [pa.array(np.repeat(ids, tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(ids))), pa.array(k.ravel())]
                    yield pa.RecordBatch.from_arrays(cols, ["node", "tab", "bucket"])

    return run


def _check(m: int, tables: int, threshold: float):
    def links(group: pa.Table, table: int, lo: int, hi: int) -> pa.RecordBatch | None:
        """(u, null, partners) of each node with links that no earlier table has, and (u, v, null) of a forest of them."""
        node, block, n = (group.column(c).to_numpy() for c in ("node", "block", "n"))
        x = unit(group.column("vec").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(len(node), -1))
        if lo == hi:
            left = right = np.arange(len(node))
        else:
            left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        u, v = np.nonzero(x[left] @ x[right].T >= threshold)
        u, v = left[u], right[v]
        if lo == hi:
            u, v = u[u < v], v[u < v]
        if table and len(u):
            used = np.unique(np.concatenate([u, v]))
            k = np.zeros((len(node), table), np.int64)
            k[used] = keys(x[used], m, tables, table)
            new = np.concatenate([~(k[u[i : i + 4096]] == k[v[i : i + 4096]]).any(axis=1) for i in range(0, len(u), 4096)])
            u, v = u[new], v[new]
        if not len(u):
            return None
        partners = (np.bincount(u, n[v], len(node)) + np.bincount(v, n[u], len(node))).astype(np.int64)
        has, joined = np.flatnonzero(partners), forest(len(node), u, v)
        none = lambda count: pa.nulls(count, pa.int64())
        cols = (pa.array(node[has]), pa.array(node[u[joined]])), (none(len(has)), pa.array(node[v[joined]])), (pa.array(partners[has]), none(len(joined)))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in cols], ["u", "v", "partners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def close():
            if now is None:
                return None
            return links(pa.Table.from_batches(held), now[1], now[2], now[3])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy() for k in ("bucket", "tab", "lo", "hi")]
            new = np.zeros(b.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(int(c[i]) for c in cols)
                if key != now:
                    if (out := close()) is not None:
                        yield out
                    held, now = [], key
                held.append(b.slice(i, j - i))
        if (out := close()) is not None:
            yield out

    return run


def near_vectors(df: DataFrame, id_col: str, vec_col: str, threshold: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept) of each row.

    Two rows are linked where the cosine of their vectors is at least ``threshold``; n_links counts the
    other rows, equal vectors too. Vectors that are null, empty, zero or hold null, infinite or not-a-number components
    have no links. Vectors of different lengths are not compared. component_id is the smallest id reachable; a
    null id is the smallest of nothing. Repeated rows are rows like any other. Other columns are dropped.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
    good = F.coalesce((F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = written(rows.withColumn("node", F.when(good, F.xxhash64("vec"))), "vectors")
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("id").alias("id"))
    nodes = written(nodes, "nodes")
    m, tables = plan(nodes.count(), threshold)
    hashed = nodes.select("node", "vec").repartition(F.col("node")).mapInArrow(_hash(m, tables), "node long, tab int, bucket long")
    hashed = written(hashed, "keys")
    shared = hashed.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("c")).where("c > 1").drop("c")
    live = hashed.join(shared, ["tab", "bucket"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("tab", "bucket", "node", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    full = dealt.join(nodes.select("node", "vec", "n"), "node").repartition("bucket", "tab", "lo", "hi").sortWithinPartitions("bucket", "tab", "lo", "hi")
    links = written(full.mapInArrow(_check(m, tables, threshold), "u long, v long, partners long"), "links")
    found = written(connected_components(links.where("v is not null").select("u", "v")), "components")
    partners = links.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("partners").alias("partners"))
    placed = nodes.join(found, "node", "left").join(partners, "node", "left").select("node", "id", "n", F.coalesce("component", "node").alias("component"), F.coalesce("partners", F.lit(0)).alias("partners"))
    smallest = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    named = placed.join(smallest, "component").select("node", "component_id", (F.col("partners") + F.col("n") - 1).alias("n_links"))
    own = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    result = rows.select("id", "node").join(named, "node", "left")
    return result.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))

"""MinHash near-dedup with tensored banding.

Two collections of S small keys, each of ROWS minhashes, make S x S table keys, one for each pair
of a key of the first and one of the second: 2 x S x ROWS minhashes instead of S^2 x 2 x ROWS. Two texts of Jaccard
similarity s share a table key with probability (1 - (1 - s^ROWS)^S)^2; S is the least for which that is
1 - MISS at the threshold. A small key that only one
text has is dropped before the pairs are formed, since no table key with it can be shared.

Equal sets are one node. In each table bucket all nodes are compared with one centre; nodes that then are in one component
need no more comparisons. Buckets that still hold several components are joined to clusters, and a cluster's nodes dealt out in
blocks of BLOCK; every pair of blocks that share such a bucket goes to one task, which compares the nodes of different
components: first by the minhashes that agree, where the bound is five standard deviations below what a pair at the threshold has,
then by their full sets. So no link between nodes that share a bucket is lost (but for one in a
million by that bound), and a large group of near copies costs a few comparisons a node and never a row for each pair.
All links are confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, pieces, row_key, text_slice, written
from .components import connected_components
from .textops import shingle_sets

ROWS, WORDS, MISS, MOST_SIDES = 5, 5, 0.002, 64
_rng = np.random.default_rng(66)
_MUL = (_rng.integers(0, 2**63, 2 * MOST_SIDES * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_XOR = _rng.integers(0, 2**63, 2 * MOST_SIDES * ROWS, dtype=np.uint64)[:, None]
_KEYS = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Nodes in a block, of which a task holds two.
BLOCK = 256
#: Members that one task compares with a centre in one go.
GROUP = 64


def sides(share: float) -> int:
    """S for a threshold; a ValueError where more than MOST_SIDES would be needed to miss no more than MISS (below 0.64)."""
    each = 1 - math.sqrt(1 - MISS)
    needed = max(1, math.ceil(math.log(each) / math.log1p(-min(max(share, 1e-3), 0.999) ** ROWS)))
    if needed > MOST_SIDES:
        raise ValueError(f"a threshold of {share:.2f} would need {needed} keys a side; {MOST_SIDES} are the most")
    return needed


def minhashes(hashes: np.ndarray, count: int) -> np.ndarray:
    out = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(out, ((hashes[None, i : i + 1024] ^ _XOR[:count]) * _MUL[:count]).min(axis=1), out=out)
    return out


def small_keys(m: np.ndarray) -> np.ndarray:
    """2 S keys of 2 x S x ROWS minhashes: the first S are one collection, the others the second."""
    return mix((m.reshape(-1, ROWS) * _KEYS).sum(axis=1) + np.arange(len(m) // ROWS, dtype=np.uint64)).view(np.int64)


def set_key(hashes: np.ndarray) -> int:
    return int(mix(mix(hashes * _KEYS[0]).sum(keepdims=True) + np.array([len(hashes)], np.uint64) * _KEYS[1]).view(np.int64)[0])


def _sketches(keys_a_side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, node, keys, lows = [], [], [], []
            for i, j in pieces(batch, 2):
                for s in shingle_sets(*text_slice(batch.column(2), i, j), WORDS):
                    size.append(len(s))
                    m = minhashes(s, 2 * keys_a_side * ROWS) if len(s) else None
                    node.append(set_key(s) if len(s) else None)
                    keys.append(small_keys(m).tolist() if len(s) else None)
                    lows.append((mix(m) & np.uint64(0xFF)).astype(np.uint8).tobytes() if len(s) else None)
            cols = [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(lows, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "rid", "n", "node", "keys", "lows"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [s.tobytes() for i, j in pieces(batch, 1) for s in shingle_sets(*text_slice(batch.column(1), i, j), WORDS)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["node", "hashes"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    centre, base = None, None
    for b in batches:
        rows: tuple[list, ...] = ([], [], [], [])
        for c, m, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            s = np.frombuffer(raw.as_py(), np.uint64)
            if m is None:
                centre, base = c, s
                continue
            assert c == centre
            a, z = (s, base) if len(s) < len(base) else (base, s)
            at = np.searchsorted(z, a)
            both = int((z[np.minimum(at, len(z) - 1)] == a).sum())
            for col, v in zip(rows, (c, m, both, len(s) + len(base) - both), strict=True):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["u", "v", "both", "either"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, both, either) of each pair (u, v): the sizes of the intersection and the union of their sets. Written.

    A centre u with many members is dealt out in groups; its set travels once a group, a member's once a pair.
    """
    counts = pairs.groupBy("u").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    dealt = pairs.join(counts, "u").withColumn("g", F.pmod(F.xxhash64("v"), "groups").cast("int"))
    centres = counts.select("u", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"))
    rows = (
        centres.join(sets, F.col("u") == F.col("node")).select("u", F.lit(None).cast("long").alias("v"), "hashes", "g")
        .unionByName(dealt.join(sets, F.col("v") == F.col("node")).select("u", "v", "hashes", "g"))
    )
    sorted_ = rows.repartition("u", "g").sortWithinPartitions("u", "g", F.col("v").asc_nulls_first())
    # an empty group has its centre alone
    return written(sorted_.select("u", "v", "hashes").mapInArrow(_compare, "u long, v long, both long, either long"), "compared")


def _facing(share: int, of: int):
    """Links between nodes of different components, from rows of a pair of blocks (cluster, lo, hi, block, node, component, lows, hashes)."""

    def links(group: list[tuple]) -> list[tuple[int, int]]:
        lo, hi = group[0][1], group[0][2]
        left = [r for r in group if r[3] == lo]
        right = left if lo == hi else [r for r in group if r[3] == hi]
        if not left or not right:
            return []
        sets = {r[4]: np.frombuffer(r[7], np.uint64) for r in group}
        low = lambda rows: np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(len(rows), -1)
        a, b = low(left), low(right)
        m, p = a.shape[1], share / of + (1 - share / of) / 256
        least = p * m - 5 * math.sqrt(p * (1 - p) * m)
        size_a, size_b = (np.array([len(sets[r[4]]) for r in rows]) for rows in (left, right))
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.get(x, x) != x:
                x = up[x]
            return x

        out = []
        for i, r in enumerate(left):
            agree = (b == a[i]).sum(axis=1)
            fits = (agree >= least) & (size_b * of >= size_a[i] * share) & (size_a[i] * of >= size_b * share)
            for j in np.flatnonzero(fits).tolist():
                x, y = root(r[5]), root(right[j][5])
                if x == y or (lo == hi and j <= i):
                    continue
                s, z = sets[r[4]], sets[right[j][4]]
                if len(s) > len(z):
                    s, z = z, s
                at = np.searchsorted(z, s)
                both = int((z[np.minimum(at, len(z) - 1)] == s).sum())
                if both * of >= share * (len(s) + len(z) - both):
                    out.append((r[4], right[j][4]))
                    up[x] = y
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][:3] != row[:3]:
                    found += links(group)
                    group = []
                group.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])
        found = links(group) if group else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return run


def _buckets(nodes: DataFrame, s: int) -> DataFrame:
    """(bucket, node, n) of the table keys that at least two nodes share."""
    single = nodes.select("node", "n", F.posexplode("keys").alias("place", "key"))
    shared = single.groupBy("place", "key").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    live = single.join(shared, ["place", "key"]).groupBy("node").agg(
        F.first("n").alias("n"),
        F.collect_list(F.when(F.col("place") < s, F.struct("place", "key"))).alias("a"),  # at most s each
        F.collect_list(F.when(F.col("place") >= s, F.struct("place", "key"))).alias("b"),
    )
    tables = live.select("node", "n", F.explode("a").alias("x"), "b").select("node", "n", "x", F.explode("b").alias("y")).select(F.xxhash64("x.place", "x.key", "y.place", "y.key").alias("bucket"), "node", "n")
    full = tables.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    return written(tables.join(full, "bucket"), "buckets")


def _first():
    """The row with the smallest id, null last, and of those the smallest key."""
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid"))


def _linked(df: DataFrame, id_col: str, text_col: str, share: int, of: int) -> tuple[DataFrame, DataFrame]:
    """(id, rid, n, node, ...) of each row, and (node, id, rid, component) of each distinct set, with the first of its rows."""
    keyed = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keyed = keyed.withColumn("rid", row_key("id", "text"))
    rows = written(keyed.select("id", "rid", "text").mapInArrow(_sketches(sides(share / of)), "id long, rid long, n long, node long, keys array<long>, lows binary"), "sketches")
    nodes = rows.where("node is not null").groupBy("node").agg(_first().alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("lows").alias("lows"))
    nodes = written(nodes.select("node", "first.id", "first.rid", "n", "keys", "lows"), "nodes")
    buckets = _buckets(nodes, sides(share / of))
    near = (F.col("n") * of >= F.col("m") * share) & (F.col("m") * of >= F.col("n") * share)

    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "rid")
    texts = keyed.join(wanted, "rid").dropDuplicates(["rid"])
    sets = written(texts.select("node", "text").mapInArrow(_sets, "node long, hashes binary"), "sets")

    centre = buckets.groupBy("bucket").agg(F.min(F.struct("node", F.col("n").alias("m"))).alias("c"))
    star = buckets.join(centre, "bucket").where("node <> c.node").select("bucket", F.col("c.node").alias("u"), F.col("node").alias("v"), "n", F.col("c.m").alias("m"))
    links = compared(star.where(near).select("u", "v").distinct(), sets).where(F.col("both") * of >= F.col("either") * share).select("u", "v")
    found = written(connected_components(links), "components")

    placed = written(buckets.select("bucket", "node").join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")), "placed")
    split = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("node").alias("centre")).where("lo < hi").select("bucket", "centre")
    mixed = written(placed.join(split, "bucket"), "mixed")
    cluster = written(connected_components(written(mixed.select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct(), "clusters-links")), "clusters").withColumnRenamed("component", "cluster")
    blocks = cluster.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = written(cluster.join(blocks, "cluster").select("cluster", "node", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")), "dealt")
    # many buckets hold nodes of the same blocks: each such set of blocks counts once
    met = mixed.join(dealt, "node").groupBy("bucket", "cluster").agg(F.sort_array(F.collect_set("block")).alias("met")).select("cluster", "met").distinct()
    facing = met.select("cluster", "met", F.explode("met").alias("lo")).select("cluster", "lo", F.explode("met").alias("hi")).where("lo <= hi").distinct()
    ends = facing.select("cluster", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))
    full = dealt.join(mixed.select("node", "component").distinct(), "node").join(nodes.select("node", "lows"), "node").join(sets, "node")
    tasks = ends.join(full, ["cluster", "block"]).select("cluster", "lo", "hi", "block", "node", "component", "lows", "hashes")
    order = ["cluster", "lo", "hi"]
    more = written(tasks.repartition(*order).sortWithinPartitions(*order).mapInArrow(_facing(share, of), "u long, v long"), "more-links")
    if not more.isEmpty():
        found = written(connected_components(written(links.unionByName(more), "all-links")), "components")
    return rows, nodes.join(found, "node", "left").select("node", "id", "rid", F.coalesce("component", "node").alias("component"))


def near_duplicates(df: DataFrame, id_col: str, text_col: str, share: int = 85, of: int = 100) -> DataFrame:
    """(id, rid, n_shingles, component_id, kept) of each row; rid is row_key(id, text).

    Rows are linked where of * intersection >= share * union of their sets of five-word shingles (words in lower case).
    component_id is the smallest id reachable by links, kept tells whether that is the row's own. Null or wordless
    texts have empty sets and are linked with nothing. A null id never is the smallest unless all are null, and such a
    row is kept only where its component has null ids alone. Rows with equal ids and texts get equal results. Other columns are dropped.
    A threshold below 0.64 is refused (see sides).
    """
    rows, labelled = _linked(df, id_col, text_col, share, of)
    smallest = labelled.groupBy("component").agg(F.min("id").alias("component_id"))
    named = labelled.join(smallest, "component").select("node", "component_id")
    result = rows.join(named, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return result.select(F.col("id").alias(id_col), "rid", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def deduplicated(df: DataFrame, id_col: str, text_col: str, share: int = 80, of: int = 100) -> DataFrame:
    """One row, with all columns, of each group that near_duplicates links: that with the smallest id, null last, whatever ids repeat or
    are null. Texts without words are linked with nothing and stay, one of each id and text."""
    rows, labelled = _linked(df, id_col, text_col, share, of)
    chosen = labelled.groupBy("component").agg(_first().alias("first")).select("first.rid")
    kept = chosen.unionByName(rows.where("node is null").select("rid")).select(F.col("rid").alias("_mh_rid")).distinct()
    keyed = df.withColumn("_mh_rid", row_key(id_col, text_col))
    return keyed.join(kept, "_mh_rid", "left_semi").dropDuplicates(["_mh_rid"]).drop("_mh_rid")

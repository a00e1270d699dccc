"""Sharding: a uniform shuffle with exact shard sizes, by a hypergeometric communication matrix.

The rows stand in P source parts. How many rows of each part go to each shard is drawn exactly
(multivariate hypergeometric, on the driver: at most 512 x (shards x 32) counts whatever the input). Each
part permutes its rows and cuts them by its row of the matrix; after the exchange each shard
permutes again. A shard is itself cut into blocks of exact sizes by a second draw, so that the last
permutation sorts a bounded block and not a whole shard, and slots still are gapless.
"""

from __future__ import annotations

import json
import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

MOST_PARTS, MOST_BLOCKS = 512, 32


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Draws of ``good`` in n draws without replacement; beyond numpy's range by halving the problem."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    if 2 * n > good + bad:
        return good - _hypergeometric(rng, good, bad, good + bad - n)
    # ratio of uniforms, as in Stadlober's HRUA, with logarithms of factorials
    total = good + bad
    p = good / total
    mean = n * p
    sd = math.sqrt((total - n) * n * p * (1 - p) / (total - 1) + 0.5)
    mode = (n + 1) * (good + 1) // (total + 2)
    pick = random.Random(int(rng.integers(2**63)))

    def log_weight(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(n - k + 1) + math.lgamma(bad - n + k + 1))

    top = log_weight(mode)
    width = 2 * math.sqrt(2 / math.e) * sd + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = pick.random(), pick.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u) if u else -1
        if max(0, n - bad) <= k <= min(n, good) and 2 * math.log(u) <= log_weight(k) - top:
            return k


def communication_matrix(rows_of: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Counts[part, shard]: row sums are ``rows_of``, column sums are ``sizes``."""
    rng = np.random.default_rng(seed)
    left = list(sizes)
    out = np.zeros((len(rows_of), len(sizes)), np.int64)
    for i, n in enumerate(rows_of):
        rest = sum(left)
        for j, room in enumerate(left):
            k = _hypergeometric(rng, room, rest - room, n)
            out[i, j] = k
            rest -= room
            n -= k
        left = [a - int(b) for a, b in zip(left, out[i], strict=True)]
    return out


def even(n: int, k: int) -> list[int]:
    """k sizes that sum to n and are at most one apart."""
    return [n // k + (i < n % k) for i in range(k)]


def _constant(value: list, kind: str) -> Column:
    """A small table of numbers as a literal that the JVM parses once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def shard(df: DataFrame, shards: int, seed: int = 0, rows_per_part: int = 5000) -> DataFrame:
    """All columns of ``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes are at most one apart. Every assignment of rows to (shard, slot) is equally likely up to the
    quality of the hash. The result depends on seed and on how the input is split. Null or repeated keys and
    repeated rows are rows like any other: rows are told apart by their place, not by a key. An empty table
    gives an empty table; columns named shard, slot or starting with ``_sh_`` are replaced. The rows are
    written once to the shared folder, so pass only the columns that should travel.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    mine = [c for c in df.columns if c not in ("shard", "slot") and not c.startswith("_sh_")]
    rows = written(df.select(*mine, F.monotonically_increasing_id().alias("_sh_row")), "shard-rows")
    n = rows.count()
    parts = min(MOST_PARTS, max(1, math.ceil(n / rows_per_part)))
    part = F.pmod(F.xxhash64("_sh_row", F.lit(seed), F.lit("part")), F.lit(parts)).cast("int")
    counted = {r[0]: r[1] for r in rows.groupBy(part.alias("p")).count().collect()}  # at most MOST_PARTS rows
    counts = [counted.get(i, 0) for i in range(parts)]
    sizes = even(n, shards)
    matrix = communication_matrix(counts, sizes, seed)
    blocks = min(MOST_BLOCKS, max(1, math.ceil(n / shards / rows_per_part)))
    room = [even(s, blocks) for s in sizes]
    first = [[0, *np.cumsum(r[:-1]).tolist()] for r in room]
    cells = [communication_matrix(matrix[:, s].tolist(), room[s], seed + 1 + s) for s in range(shards)]
    ends = np.cumsum(matrix, axis=1)
    plan = [[ends[p].tolist(), (ends[p] - matrix[p]).tolist(), [np.cumsum(cells[s][p]).tolist() for s in range(shards)]] for p in range(parts)]

    spark = df.sparkSession
    layout = (  # at most MOST_PARTS rows of shards x (MOST_BLOCKS + 2) numbers
        spark.range(1)
        .select(F.posexplode(F.from_json(F.lit(json.dumps([{"e": a, "f": b, "c": c} for a, b, c in plan])), "array<struct<e:array<bigint>,f:array<bigint>,c:array<array<bigint>>>>")).alias("_sh_p", "_sh_x"))
        .select("_sh_p", "_sh_x.*")
    )
    order = F.xxhash64("_sh_row", F.lit(seed), F.lit("order"))
    again = F.xxhash64("_sh_row", F.lit(seed), F.lit("again"))
    ranked = rows.withColumn("_sh_p", part).withColumn("_sh_r", F.row_number().over(Window.partitionBy("_sh_p").orderBy(order, "_sh_row")) - 1)
    placed = (
        ranked.join(F.broadcast(layout), "_sh_p")
        .withColumn("shard", F.size(F.filter("e", lambda x: x <= F.col("_sh_r"))))
        .withColumn("_sh_q", F.col("_sh_r") - F.element_at("f", F.col("shard") + 1))
        .withColumn("_sh_b", F.size(F.filter(F.element_at("c", F.col("shard") + 1), lambda x: x <= F.col("_sh_q"))))
    )
    start = F.element_at(F.element_at(_constant(first, "array<array<bigint>>"), F.col("shard") + 1), F.col("_sh_b") + 1)
    slot = start + F.row_number().over(Window.partitionBy("shard", "_sh_b").orderBy(again, "_sh_row")) - 1
    return placed.select(*mine, F.col("shard"), slot.cast("long").alias("slot"))


def sharded_documents(documents: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """The contract's columns for ``documents(doc_id, text)``: a null text has size 16 and the CRC of no bytes."""
    light = documents.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    return shard(light, shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

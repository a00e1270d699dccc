"""Global work on distinct words without a row for every occurrence.

Texts are split into words where they stand. A task cuts its texts into blocks; in a block each distinct
word gets a code, and the texts become code sequences (the words' positions). Only the distinct words of
a block travel, dealt by their hash, so that one task sees all blocks' copies of a word and answers each distinct
word once; a word that is in every text still is in each block just once. The answers go back to their
block, where the codes put them into place.

A written table holds both kinds of rows:
  kind 0: block, bucket, payload = codes, counts and words of the block that fall into the bucket
  kind 1: block, ids, flags, sizes (words per text), payload = the texts' codes
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import pieces, text_slice, written_by

SCHEMA = "kind int, block long, bucket int, ids array<long>, flags array<boolean>, sizes array<long>, payload binary"
_ARROW = pa.schema(
    [("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("payload", pa.binary())]
)


class Codes(dict):
    """Numbers words in the order in which they first come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def squeeze(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one compressed string; numbers as little-endian unsigned 32-bit, bytes in four planes."""
    parts = []
    for a in arrays:
        raw = a if isinstance(a, bytes) else np.ascontiguousarray(np.asarray(a, "<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
        parts += [len(raw).to_bytes(8, "little"), raw]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def expand(blob: bytes, kinds: str) -> list:
    """What squeeze was given; kinds: "n" for numbers, "b" for bytes."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        part = raw[at + 8 : at + 8 + n]
        out.append(part if kind == "b" else np.ascontiguousarray(np.frombuffer(part, np.uint8).reshape(4, -1).T).view("<u4").ravel())
        at += 8 + n
    return out


def words_of(lengths: np.ndarray, joined: bytes) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [joined[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def bucket_count(df: DataFrame) -> int:
    return min(8192, max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def code_blocks(df: DataFrame, id_col: str, flag_col: str | None, text_col: str, split: Callable[[], Callable[[bytes], list]], buckets: int, block_bytes: int = 24 << 20) -> DataFrame:
    """The written table. split() gives, in the task, the function from a text's bytes to its words (bytes or str).

    A null text has no words, a null flag counts as false. Counts in kind 0 are the occurrences in texts whose flag holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, cut, number = TaskContext.get().partitionId(), split(), 0
        codes, counts, size = Codes(), np.zeros(0, np.int64), 0

        def texts(ids, flags, arrays) -> pa.RecordBatch:
            row = [[1], [block], [None], [ids], [flags], [[len(a) for a in arrays]], [squeeze(np.concatenate(arrays) if arrays else np.zeros(0, np.uint32))]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _ARROW, strict=True)], schema=_ARROW)

        def dictionary() -> pa.RecordBatch:
            words = [w if isinstance(w, bytes) else w.encode() for w in codes]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            rows: list[list] = [[] for _ in _ARROW]
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                at = order[a:b]
                mine = [words[i] for i in at]
                cells = 0, block, int(bucket[at[0]]), None, None, None, squeeze(np.diff(at, prepend=0), counts[at], np.fromiter(map(len, mine), np.int64, len(mine)), b"".join(mine))
                for col, v in zip(rows, cells, strict=True):
                    col.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _ARROW, strict=True)], schema=_ARROW)

        block = part << 32
        for batch in batches:
            ids, flags = batch.column(0).to_pylist(), [bool(x) for x in batch.column(1).to_pylist()]
            for i, j in pieces(batch, 2, 1 << 20):
                data, off = text_slice(batch.column(2), i, j)
                raw, arrays = data.tobytes(), []
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    words = cut(raw[a:b])
                    arrays.append(np.fromiter(map(codes.__getitem__, words), np.uint32, len(words)))
                if len(counts) < len(codes):
                    counts = np.concatenate([counts, np.zeros(2 * len(codes) - len(counts), np.int64)])
                learn = [x for x, f in zip(arrays, flags[i:j], strict=True) if f]
                if learn:
                    seen = np.bincount(np.concatenate(learn))
                    counts[: len(seen)] += seen
                yield texts(ids[i:j], flags[i:j], arrays)
                size += len(raw)
                if size >= block_bytes:
                    if codes:
                        yield dictionary()
                    codes, counts, size, number = Codes(), np.zeros(0, np.int64), 0, number + 1
                    block = (part << 32) + number
        if codes:
            yield dictionary()

    flag = F.lit(False) if flag_col is None else F.col(flag_col)
    return written_by(df.select(F.col(id_col).cast("long"), flag, text_col).mapInArrow(run, SCHEMA), "blocks", buckets, "block")


def answered(blocks: DataFrame, buckets: int, answer: Callable[[Iterator[tuple[int, int, bytes]]], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """(block, bucket, payload) as ``answer`` gives them from the kind 0 rows of whole buckets, a fixed number of partitions so that none gathers many buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for block, bucket, payload in answer(rows):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([payload], pa.binary())], ["block", "bucket", "payload"])

    return blocks.where("kind = 0").select("block", "bucket", "payload").repartition(buckets, "bucket").mapInArrow(run, "block long, bucket int, payload binary")


def reassembled(blocks: DataFrame, answers: DataFrame, start: Callable[[], object], schema: str) -> DataFrame:
    """Runs over each block: its answers first, then its texts. The texts, written in buckets by block, don't move; the answers come to them.

    start() gives, in the task, an object with take(payload), one answer of the block, and texts(ids, flags, sizes, codes),
    which gives a RecordBatch. A block is bounded by block_bytes and the longest text.
    """

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        worker = start()
        for payload in replies.column("payload"):
            worker.take(payload.as_py())
        parts = []
        for ids, flags, sizes, payload in zip(*(texts.column(c) for c in ("ids", "flags", "sizes", "payload")), strict=True):
            parts.append(worker.texts(ids.as_py(), flags.as_py(), np.asarray(sizes.as_py(), np.int64), expand(payload.as_py(), "n")[0]))
        return pa.Table.from_batches(parts) if parts else empty.value

    empty = blocks.sparkSession.sparkContext.broadcast(to_arrow_schema(T.StructType.fromDDL(schema)).empty_table())
    texts = blocks.where("kind = 1").select("block", "ids", "flags", "sizes", "payload")
    return texts.groupBy("block").cogroup(answers.select("block", "payload").groupBy("block")).applyInArrow(run, schema)

"""Packing of tokenised documents into sequences by the sum-of-squares rule.

A piece of length l goes to the place (an open bin with gap g >= l, or a new bin) for which the sum over
gaps of the squared number of open bins with that gap becomes smallest. The rule looks at sizes alone,
so it runs on groups of (document, length) rows, each group in one task: texts and ids never travel. Groups
have a bounded expected size; a group places its pieces by falling length. Then the worst-filled bins of all
groups are opened again and their pieces placed anew by the same rule, so that the number of groups hardly shows in
the number of sequences.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: The added tokens of byte_bpe_50k.json, which its rank file lacks; tokenizers finds them in any text, also with add_special_tokens=False.
ADDED = {"<|endoftext|>": 50256}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
FREE = np.iinfo(np.int64).max
#: Runs of white space from here on overflow the stack of the fast encoder's pattern matcher; it stands ten times as many.
RUN = 20_000


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin numbers (gapless from 0) and offsets for pieces with 1 <= length <= capacity, placed in the given order.

    Adding to a bin with gap g changes the sum of squares by 2(N[g-l] - N[g]) + 2, or by 1 - 2 N[l] where it
    fills the bin; a new bin by 2 N[capacity-l] + 1. Ties go to the smallest gap, a new bin last.
    """
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; gap 0 is never counted
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, at, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, l in enumerate(lengths.tolist()):
        here = count[l:]
        cost = 2 * (count[: capacity + 1 - l] - here) + 2
        cost[0] -= 1
        cost[here == 0] = FREE
        k = int(cost.argmin())
        fresh = 2 * int(count[capacity - l]) + 1 if l < capacity else 0
        if cost[k] <= fresh:
            gap = l + k
            b = bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, made
            made += 1
        where[i], at[i] = b, capacity - gap
        if gap > l:
            bins[gap - l].append(b)
            count[gap - l] += 1
    return where, at


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all are full but, where n isn't a multiple, the first."""
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def tokenizer_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def token_encoder(ranks: bytes, pattern: str, added: dict[str, int] | None = None):
    """The function from a text to its ids (an array) by a rank file's bytes; ``added`` tokens are ids of their own wherever they stand in a text.

    A text with a run of RUN or more white space characters is split by ``regex``, which needs no stack, and encoded word by word; the ids are the same.
    """
    import regex
    import tiktoken

    added = added or {}
    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=added)
    run, words = regex.compile(rf"\s{{{RUN}}}"), regex.compile(pattern)
    marks = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None

    def encode(text: str) -> np.ndarray:
        if len(text) < RUN or not run.search(text):
            return enc.encode_to_numpy(text, allowed_special="all")
        ids: list[int] = []
        for part in marks.split(text) if marks else [text]:
            if part in added:
                ids.append(added[part])
            else:
                for word in words.findall(part):
                    ids += enc._encode_single_piece(word)
        return np.array(ids, np.uint32)

    return encode


def token_pieces(df: DataFrame, id_col: str, text_col: str, ranks: bytes, pattern: str, end_id: int, capacity: int, added: dict[str, int] | None = None) -> DataFrame:
    """PIECES of every text: its ids, then ``end_id``, cut to the capacity. A null text counts as empty."""
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern, added))  # a vocabulary file, about 1 MB whatever the corpus

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = token_encoder(*shared.value)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode_text(text.as_py() or "")
                raw = np.append(ids, end_id).astype("<u4").tobytes()
                for k, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                    for col, v in zip(out, (key, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])), strict=True):
                        col.append(v)
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(encode, PIECES)


def pack(pieces: DataFrame, capacity: int, rows_per_group: int = 20_000, reopen: int = 64) -> DataFrame:
    """``pieces`` (as PIECES, length 1 to ``capacity``) with sequence_id and offset.

    Offsets are gapless from 0 in every sequence. Full pieces are sequences of their own. Repeated rows
    are packed once each; an empty table gives an empty one; columns beyond PIECES are dropped. In the first
    round each group packs its rows alone; bins that it leaves with a gap of ``reopen`` tokens or more are
    taken apart, and their pieces are packed anew in groups of the same size. The pieces are written to the
    shared folder once.
    """
    names = [c.split()[0] for c in PIECES.split(", ")]
    rows = written(pieces.select(*names, F.monotonically_increasing_id().alias("row")), "pieces")
    n = rows.where(F.col("length") < capacity).count()
    whole = rows.where(F.col("length") >= capacity).select(*names, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    columns = f"{PIECES}, row long, sequence_id long, offset long, gap long"

    def round_of(df: DataFrame, groups: int, first_id: int) -> DataFrame:
        def place(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("length", "descending"), ("row", "ascending")])
            length = rows.column("length").to_numpy()
            where, at = sum_of_squares(length, capacity)
            used = np.bincount(where, weights=length).astype(np.int64)
            ids = where * groups + key[0].as_py() + first_id
            return rows.select([*names, "row"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(at)).append_column("gap", pa.array(capacity - used[where]))

        group = F.pmod(F.xxhash64("row", F.lit(first_id)), F.lit(groups))
        return df.withColumn("g", group).repartition(groups, "g").groupBy("g").applyInArrow(place, columns)

    groups = max(1, math.ceil(n / rows_per_group))
    first = written(round_of(rows.where(F.col("length") < capacity), groups, 0), "packed")
    kept = first.where(F.col("gap") < reopen)
    open_ = first.where(F.col("gap") >= reopen).select(*names, "row")
    again = round_of(open_, max(1, math.ceil(open_.count() / rows_per_group)), 1 << 40)
    final = [*names, "sequence_id", "offset"]
    return whole.select(final).unionByName(kept.select(final)).unionByName(again.select(final))


def packed_documents(documents: DataFrame, ranks_path: str, pattern: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """The contract's rows for ``documents(doc_id, text)``."""
    return pack(token_pieces(documents, "doc_id", "text", tokenizer_ranks(ranks_path), pattern, end_id, capacity, ADDED), capacity)

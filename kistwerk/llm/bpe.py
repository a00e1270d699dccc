"""Byte-level BPE by a global shuffle of distinct words.

Texts are split into pre-tokens; each distinct pre-token of the corpus is encoded once; its ids are joined
back and put into the places of the pre-token (see blocks.py, which also says what travels).
Decoding looks the ids up in the token-byte table, which has as many rows as the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import answered, bucket_count, code_blocks, expand, reassembled, squeeze, words_of

#: Distinct words that an encoding task remembers; beyond it, it starts afresh and encodes some a second time.
REMEMBERED = 2_000_000


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def token_table(ranks: bytes) -> list[bytes]:
    """Bytes of each id; ids without a rank have none."""
    pairs = [(int(b), base64.b64decode(a)) for a, b in (line.split() for line in ranks.splitlines() if line)]
    out = [b""] * (max((i for i, _ in pairs), default=-1) + 1)
    for i, raw in pairs:
        out[i] = raw
    return out


def _splitter(pattern: str):
    def start():
        import regex

        find = regex.compile(pattern).findall
        return lambda raw: find(raw.decode("utf-8", "replace"))

    return start


def encode(df: DataFrame, id_col: str, text_col: str, ranks: bytes, pattern: str, digests: bool = False) -> DataFrame:
    """(id, ids array<int>) of each row, or with ``digests`` (id, n_tokens, ids_sha256, decoded_sha256).

    A null text is empty and has no ids. Repeated rows and null ids give as many rows. Other columns are dropped.
    """
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast(ranks)  # a vocabulary file, about 1 MB whatever the corpus

    def answer(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        import tiktoken

        table = {raw: i for i, raw in enumerate(token_table(shared.value)) if raw}
        one = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})._encode_single_piece
        known: dict[bytes, list[int]] = {}
        for block, bucket, payload in rows:
            steps, _, lengths, joined = expand(payload, "nnnb")
            counts, ids = [], []
            if len(known) > REMEMBERED:
                known = {}
            for word in words_of(lengths, joined):
                got = known.get(word)
                if got is None:
                    known[word] = got = one(word)
                counts.append(len(got))
                ids += got
            yield block, bucket, squeeze(steps, np.array(counts, np.uint32), np.array(ids, np.uint32))

    class Texts:
        def __init__(self):
            self.table = token_table(shared.value)
            self.shown = [str(i) for i in range(len(self.table))]
            self.parts, self.ready = [], None

        def take(self, payload):
            steps, counts, ids = expand(payload, "nnn")
            self.parts.append((np.cumsum(steps.astype(np.int64)), counts.astype(np.int64), ids))

        def join(self):
            codes, counts = (np.concatenate([p[k] for p in self.parts] or [np.zeros(0, np.int64)]) for k in (0, 1))
            starts = np.cumsum(counts) - counts
            n = int(codes.max()) + 1 if len(codes) else 0
            self.start, self.count = np.zeros(n, np.int64), np.zeros(n, np.int64)
            self.start[codes], self.count[codes] = starts, counts
            self.ids = np.concatenate([p[2] for p in self.parts] or [np.zeros(0, np.uint32)])
            self.ready = True

        def texts(self, ids, flags, sizes, codes):
            if self.ready is None:
                self.join()
            count = self.count[codes]
            ends = np.cumsum(count)
            total = int(ends[-1]) if len(ends) else 0
            tokens = self.ids[np.repeat(self.start[codes] - (ends - count), count) + np.arange(total)]
            last = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
            if not digests:
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(last, pa.int32()), pa.array(tokens, pa.int32()))], ["id", "ids"])
            listed, spelled, decoded = tokens.tolist(), [], []
            for a, b in zip(last[:-1].tolist(), last[1:].tolist(), strict=True):
                mine = listed[a:b]
                spelled.append(hashlib.sha256(",".join(map(self.shown.__getitem__, mine)).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join(map(self.table.__getitem__, mine))).hexdigest())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(last)), pa.array(spelled), pa.array(decoded)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    buckets = bucket_count(df)
    blocks = code_blocks(df, id_col, None, text_col, _splitter(pattern), buckets)
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "id long, ids array<int>"
    return reassembled(blocks, answered(blocks, buckets, answer), Texts, schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str, ids_col: str, ranks: bytes) -> DataFrame:
    """(id, bytes) of each row of ids: the token-byte table joined to the ids in their order. Null ids give null, unknown ids no bytes."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(shared.value)
        size = len(table)
        for b in batches:
            out = [None if ids is None else b"".join(table[i] for i in ids if i is not None and 0 <= i < size) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "bytes"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), ids_col).mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def encoded_documents(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The contract's rows for ``documents(doc_id, text)``."""
    return encode(documents, "doc_id", "text", read_ranks(ranks_path), pattern, digests=True)

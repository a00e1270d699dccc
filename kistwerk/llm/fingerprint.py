"""Order MinHash fingerprints: sketches of texts that are sensitive to edit distance.

Each k-mer of a text is numbered by its occurrence (first, second, ... of that k-mer). For each of
SAMPLES random orders the PICKED smallest numbered k-mers are selected, put back into the order in which they
stand in the text, and hashed as a tuple. Two texts agree in a sample only if the same k-mers were selected
and stand in the same order; the share of agreeing samples is the likeness.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mix, text_slice, written

K, SAMPLES, PICKED = 12, 24, 2
PIECE, SHARED = 8192, 1 << 20  # k-mers that are put in all orders at a time; code points of a text whose k-mers are kept for its edited text
_rng = np.random.default_rng(20)
_MUL = _rng.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.uint64(pow(int(_BASE), i, 2**64)) for i in range(7)]
_LOW = np.uint64((1 << 30) - 1)
_Y, _BELOW = np.empty(SAMPLES * PIECE, np.uint64), np.empty(SAMPLES * PIECE, bool)  # scratch of ``candidates``: fresh memory costs as much as the work


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points of valid UTF-8 bytes."""
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")


def kmers(points: np.ndarray) -> np.ndarray:
    """A hash of each K code points; a text that is shorter but not empty has one k-mer, itself."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.uint64)
    p = mix(points.astype(np.uint64) + np.uint64(1))
    if n < K:
        h = np.uint64(n)
        with np.errstate(over="ignore"):
            for x in p:
                h = h * _BASE + x
        return mix(np.array([h], np.uint64))
    # p[0] B^11 + p[1] B^10 + ... + p[11], modulo 2^64, from the sums of 2, 3, 6 and 12
    two = p[:-1] * _BASE + p[1:]
    three = two[:-1] * _BASE + p[2:]
    six = three[:-3] * _POWERS[3] + three[3:]
    h = six[:-6] * _POWERS[6] + six[6:]
    return mix(h)


def numbered(h: np.ndarray) -> np.ndarray:
    """The k-mer hashes with their occurrence numbers mixed in: equal k-mers become distinct, in text order."""
    n = len(h)
    if n < 2:
        return mix(h)
    order = None
    if n <= int(_LOW):
        # bits of the hash above, the place below: one sort of plain numbers, ties in text order
        packed = (h & ~_LOW) | np.arange(n, dtype=np.uint64)
        packed.sort()
        again = np.flatnonzero((packed[1:] ^ packed[:-1]) <= _LOW) + 1
        if not len(again):
            return mix(h)
        place, before = (packed[again] & _LOW).astype(np.int64), (packed[again - 1] & _LOW).astype(np.int64)
        if (h[place] == h[before]).all():
            order = place
    if order is None:  # a very long text, or two k-mers with equal upper bits
        by_hash = np.argsort(h, kind="stable")
        s = h[by_hash]
        again = np.flatnonzero(s[1:] == s[:-1]) + 1
        order = by_hash[again]
    # the second of its kind has number 1, the one behind it 2, and so on
    i = np.arange(len(again))
    run = np.maximum.accumulate(np.where(np.diff(again, prepend=-1) > 1, i, 0))
    h = h.copy()
    h[order] += (i - run + 1).astype(np.uint64) * _BASE
    return mix(h)


def limit(n: int) -> np.uint64 | None:
    """A bound below which about 16 of n numbers lie in each order; none where n is small."""
    return np.uint64(int(2**64 * 16 / n)) if n > 64 * PICKED else None


def candidates(x: np.ndarray, few: np.uint64 | None, start: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sample, place, value) of the numbered k-mers from ``start`` on that lie below ``few`` in a sample's order, by sample, then place."""
    found = []
    for a in range(start, len(x), PIECE):
        part = x[a : a + PIECE]
        y = _Y[: SAMPLES * len(part)]
        np.bitwise_xor(part, _ADD[:, None], out=y.reshape(SAMPLES, -1))
        np.multiply(y.reshape(SAMPLES, -1), _MUL[:, None], out=y.reshape(SAMPLES, -1))
        if few is None:
            at = np.arange(len(y))
        else:
            below = np.less(y, few, out=_BELOW[: len(y)])
            word = np.flatnonzero(below.view(np.uint64))  # eight at a time: few are below
            hit = below.reshape(-1, 8)[word]
            at = (word[:, None] * 8 + np.arange(8))[hit]
        sample, place = np.divmod(at, len(part))
        found.append((sample, place + a, y[at]))
    if len(found) == 1:
        return found[0]
    sample, place, y = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    order = np.argsort(sample, kind="stable")
    return sample[order], place[order], y[order]


def _chosen(x: np.ndarray, j: int) -> np.ndarray:
    """Places of the PICKED smallest in the order of sample j, in text order."""
    return np.sort(np.argsort((x ^ _ADD[j]) * _MUL[j], kind="stable")[:PICKED])


def picked(x: np.ndarray, sample: np.ndarray, place: np.ndarray, y: np.ndarray) -> np.ndarray:
    """SAMPLES hashes of numbered k-mers, from the candidates that ``candidates`` gives; of no k-mers, zeros.

    A sample with fewer than PICKED candidates, and all where two of the smallest are equal, are chosen among all k-mers.
    """
    if len(x) == 0:
        return np.zeros(SAMPLES, np.uint64)
    starts = np.searchsorted(sample, np.arange(SAMPLES + 1))
    size = np.diff(starts)
    best = np.empty((PICKED, SAMPLES), np.int64)
    sure = len(x) >= PICKED and size.min() >= PICKED
    if sure:
        y = y.copy()
        for i in range(PICKED):
            at = np.flatnonzero(y == np.repeat(np.minimum.reduceat(y, starts[:-1]), size))
            if len(at) != SAMPLES:
                sure = False
                break
            best[i] = place[at]
            y[at] = np.uint64(2**64 - 1)
    if sure:
        best.sort(axis=0)
    else:
        best = np.stack([_chosen(x, j) for j in range(SAMPLES)], axis=1)
    h = np.full(SAMPLES, len(best), np.uint64)
    for v in x[best]:
        h = (h ^ v) * _BASE
        h ^= h >> np.uint64(29)
    return h


def sketch(points: np.ndarray) -> np.ndarray:
    """SAMPLES hashes of a text's code points; of an empty text, zeros."""
    x = numbered(kmers(points))
    return picked(x, *candidates(x, limit(len(x))))


class Sketched:
    """A text's code points and their sketch, with what the sketch of a text with the same beginning can share."""

    def __init__(self, points: np.ndarray):
        self.points = points
        h = kmers(points)
        x = numbered(h)
        few = limit(len(x))
        found = candidates(x, few)
        self.sketch = picked(x, *found)
        self.shared = (h, few, found) if K <= len(points) <= SHARED else None

    def changed(self, kept: int, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first ``kept`` code points with ``tail`` behind them, and their sketch.

        K-mers that lie within the kept ones have the same hashes, occurrence numbers and places, so only those behind them are sketched anew.
        """
        points = np.concatenate([self.points[:kept], tail])
        same = kept - K + 1
        if self.shared is None or same <= 0:
            return points, sketch(points)
        h, few, (sample, place, y) = self.shared
        x = numbered(np.concatenate([h[:same], kmers(points[same:])]) if len(points) > kept else h[:same])
        before = place < same
        new = candidates(x, few, same)
        sample, place, y = (np.concatenate([old[before], more]) for old, more in zip((sample, place, y), new, strict=True))
        order = np.argsort(sample, kind="stable")
        return points, picked(x, sample[order], place[order], y[order])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples."""
    return float((a == b).mean())


def text_of(s: np.ndarray) -> str:
    """8 hex digits a sample: the upper half of its hash."""
    return (s >> np.uint64(32)).astype(">u4").tobytes().hex()


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fingerprint) of each row; a null text counts as empty. Equal texts have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_slice(batch.column(1), 0, batch.num_rows)
            prints = [text_of(sketch(code_points(data[a:b]))) for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["id", "fingerprint"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), text_col).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(key, mine: Sketched, following: Sketched) -> tuple:
    import hashlib

    n = len(mine.points)
    k = n // 4
    edited, changed = mine.changed(n - k, following.points[:k])
    text = edited.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return key, n, hashlib.sha256(text).hexdigest(), text_of(mine.sketch), text_of(changed), likeness(mine.sketch, changed), likeness(mine.sketch, following.sketch)


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """The contract's rows for ``documents(doc_id, text)``: each text against its edited text and the next one.

    The next document is the next in the order of doc_id (nulls first), then of the text's hash, then of the
    text; after the last comes the first; a single document is its own next. Rows are range-partitioned and sorted,
    so that a task meets neighbours in passing and holds two texts at a time. The two texts at the ends of every
    partition go to a second, small step (as many rows as partitions, their texts never on the driver).
    """
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text").alias("tie")
    ranged = keyed.withColumn("tie", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    # one scan gives both the finished rows and the ends, told apart by "kind"
    columns = f"{RESULT}, kind int, part int, text string"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = [c.split()[0] for c in columns.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
        end = lambda key, points, kind: (key, None, None, None, None, None, None, kind, part, points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"))
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        before = None
        for batch in batches:
            rows = []
            data, off = text_slice(batch.column(1), 0, batch.num_rows)
            for i, key in enumerate(batch.column(0).to_pylist()):
                points = code_points(data[off[i] : off[i + 1]])
                here = (key, Sketched(points))
                if before is None:
                    rows.append(end(key, points, 1))
                else:
                    rows.append((*_row(*before, here[1]), 0, part, None))
                before = here
            if rows:
                yield batch_of(rows)
        if before is not None:
            yield batch_of([end(before[0], before[1].points, 2)])

    walked = written(ranged.select("doc_id", "text").mapInArrow(walk, columns), "neighbours")
    firsts = walked.where("kind = 1").select("part", F.col("text").alias("next_text"))
    # the next partition that has rows; numbers of partitions only
    order = firsts.select("part").distinct().select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(1)))).alias("next_part"))
    lasts = walked.where("kind = 2").select("doc_id", "part", "text").join(order, "part").join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "next_text")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            rows = []
            for key, text, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = code_points(np.frombuffer(text.encode(), np.uint8)), code_points(np.frombuffer(following.encode(), np.uint8))
                rows.append(_row(key, Sketched(a), Sketched(b)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = [c.split()[0] for c in RESULT.split(", ")]
    return walked.where("kind = 0").select(*names).unionByName(lasts.mapInArrow(close, RESULT))

"""A hidden Markov language model over words, trained by Baum-Welch and scored exactly.

Hidden states emit word classes, a class emits its words by their smoothed counts:

  P(text) = sum over state paths of  start(s1) e(c1|s1) step(s1,s2) e(c2|s2) ...  x  product of P(w|c(w))

A class is the hash of a word's last four bytes (and whether that is all of it), of CLASSES values, so the
state-dependent part is a table of bounded size whatever the vocabulary. Words, their counts, N and V
cover the whole training corpus. P(w|c) = (count + 1) / (sum of count + 1 over the class's known words). Words never
seen in training are one class with the fixed probability 1 / (N + V + 1) in every state, the share that the
base model gives to them all together; the text's end is a class of its own. The model is a distribution over
the same events as the base model.

E-steps run where the class sequences lie and send expected counts, at most STATES x CLASSES numbers a task,
which are added up by class range. The forward recursion over whole texts is scaled, in double precision.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import answered, bucket_count, code_blocks, expand, reassembled, squeeze, words_of
from .common import written

STATES, CLASSES, ROUNDS = 8, 1 << 16, 5
LONG, TOGETHER = 4096, 250_000  # tokens of a span of a long text, and of the spans that are handled at a time
END, UNKNOWN = CLASSES, CLASSES + 1
RANGES = 64  # class ranges in which expected counts are added up
KEPT = 0.05  # weight of the base model in a state's emissions


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-4:], len(word) <= 4) & (CLASSES - 1)


def _start():
    return lambda raw: raw.lower().split()


def _count_words(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
    """Corpus counts for every block's words, then, with block -1, the bucket's sums by class."""
    kept, totals = [], {}
    for block, bucket, payload in rows:
        _, counts, lengths, joined = expand(payload, "nnnb")
        for word, n in zip(words_of(lengths, joined), counts.tolist(), strict=True):
            totals[word] = totals.get(word, 0) + n
        kept.append((block, bucket, payload))
    classes = {w: word_class(w) for w in totals}
    for block, bucket, payload in kept:
        steps, _, lengths, joined = expand(payload, "nnnb")
        words = words_of(lengths, joined)
        counts = np.fromiter((totals[w] for w in words), np.uint64, len(words))
        cls = np.fromiter((classes[w] for w in words), np.uint32, len(words))
        yield block, bucket, squeeze(steps, counts & np.uint64(0xFFFFFFFF), counts >> np.uint64(32), cls)
    if kept:
        sums, seen = np.zeros(CLASSES), 0
        for w, n in totals.items():
            if n:
                sums[classes[w]] += n + 1
                seen += 1
        yield -1, kept[0][1], squeeze(np.array([seen]), sums.astype("<f8").tobytes())


class Model:
    """start (S), step (S, S) and emit (S, CLASSES + 2), the columns END and UNKNOWN last."""

    def __init__(self, class_mass: np.ndarray, unknown: float, states: int = STATES, seed: int = 8):
        rng = np.random.default_rng(seed)
        self.base, self.unknown = class_mass / max(class_mass.sum(), 1e-300), unknown
        self.start = np.full(states, 1 / states)
        self.step = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
        np.fill_diagonal(self.step, 0.9 if states > 1 else 1.0)
        noisy = self.base * np.exp(rng.normal(0, 1, (states, len(self.base))))
        self._emissions(noisy / np.maximum(noisy.sum(1, keepdims=True), 1e-300))

    def _emissions(self, shares: np.ndarray) -> None:
        known = (1 - KEPT) * shares + KEPT * self.base
        self.emit = np.concatenate([(1 - self.unknown) * known, np.full((len(known), 1), self.unknown)], axis=1)

    def update(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> None:
        tiny = 1e-3
        self.start = (start + tiny) / (start + tiny).sum()
        self.step = (step + tiny) / (step + tiny).sum(1, keepdims=True)
        emit = emit[:, : CLASSES + 1] + 1e-12
        self._emissions(emit / emit.sum(1, keepdims=True))


class SideBySide:
    """Spans of tokens side by side, the longest first, as ``sizes`` has them: the first tokens of all, then the second ones, and so on.

    ``at`` is each token's place in that order; step t holds the places base[t] to base[t] + live[t], one for each of the live[t]
    longest spans. ``before`` has, for each place behind the first step, that of the token before.
    """

    def __init__(self, sizes: np.ndarray):
        self.live = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")
        self.base = np.cumsum(self.live) - self.live
        self.at = np.concatenate([self.base[:n] + i for i, n in enumerate(sizes.tolist())])
        self.last = self.base[sizes - 1] + np.arange(len(sizes))
        self.before = np.arange(len(sizes), len(self.at)) - np.repeat(self.live[:-1], self.live[1:])


def _products(emit: np.ndarray, step: np.ndarray, classes: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each span the scaled product D(c1) step D(c2) step ... D(cn), D(c) the diagonal matrix of a class's emissions."""
    order = np.argsort(-sizes, kind="stable")
    first, length = begin[order], sizes[order]
    live = np.searchsorted(-length, -np.arange(int(length[0])), "left")
    product = np.eye(len(step), dtype=np.float32)[None] * emit[classes[first]][:, None, :]
    for t, m in enumerate(live.tolist()[1:], 1):
        x = (product[:m] @ step) * emit[classes[first[:m] + t]][:, None, :]
        product[:m] = x / x.sum((1, 2), keepdims=True)
    out = np.empty_like(product)
    out[order] = product
    return out


def expected_counts(model: Model, classes: np.ndarray, first: np.ndarray, long: int = LONG, together: int = TOGETHER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of whole texts, their classes behind one another; ``first`` marks where a text begins.

    Texts are handled side by side, those of like length, about ``together`` tokens at a time. One of more than ``long`` tokens is cut into spans; the products of their
    matrices give each span the forward state that it begins with and the backward state that it ends with, so that
    the counts are those of the whole text.
    """
    states = len(model.start)
    # a class's emissions are taken relative to its largest: a factor of a token leaves the counts as they are
    top = model.emit.max(0)
    emit = np.ascontiguousarray(np.maximum(np.divide(model.emit, top, out=np.ones_like(model.emit), where=top > 0).T, 1e-30).astype(np.float32))
    step, start = model.step.astype(np.float32), model.start.astype(np.float32)
    heads = np.flatnonzero(first)
    lengths = np.diff(np.append(heads, len(classes)))
    count = -(-lengths // long)
    text = np.repeat(np.arange(len(heads)), count)
    k = np.arange(len(text)) - (np.cumsum(count) - count)[text]
    begin = heads[text] + k * long
    sizes = np.minimum(heads[text] + lengths[text] - begin, long)
    prior, ends = np.broadcast_to(start, (len(text), states)).copy(), np.ones((len(text), states), np.float32)
    cut = np.flatnonzero(count[text] > 1)
    if len(cut):
        products = _products(emit, step, classes, begin[cut], sizes[cut])
        for i, j in enumerate(cut):
            if k[j]:
                x = prior[j - 1] @ products[i - 1]
                prior[j] = (x / x.sum()) @ step
        for i, j in reversed(list(enumerate(cut))):
            if k[j] + 1 < count[text[j]]:
                x = step @ (products[i + 1] @ ends[j + 1])
                ends[j] = x / x.sum()
    ones, back = np.ones((states, states), np.float32), np.ascontiguousarray(step.T)
    starts, pairs, emits = np.zeros(states), np.zeros((states, states)), np.zeros((states, CLASSES + 2))
    out, into = np.zeros((len(text), states), np.float32), np.zeros((len(text), states), np.float32)  # at the spans' ends and heads
    order = np.argsort(-sizes, kind="stable")
    group = np.cumsum(sizes[order]) // together
    for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(text))), strict=True):
        span = order[a:b]
        lay = SideBySide(sizes[span])
        mine = np.empty(len(lay.at), np.int64)
        mine[lay.at] = np.concatenate([classes[i : i + n] for i, n in zip(begin[span].tolist(), sizes[span].tolist(), strict=True)])
        e = np.take(emit, mine, axis=0)
        alpha, gamma = np.empty_like(e), np.empty_like(e)
        ahead, total = prior[span], np.empty((b - a, states), np.float32)
        before = 0
        for t, (at, m) in enumerate(zip(lay.base.tolist(), lay.live.tolist(), strict=True)):
            p, x, y = ahead[:m], alpha[at : at + m], e[at : at + m]
            if t:
                np.matmul(alpha[before : before + m], step, out=p)
            np.multiply(p, y, out=x)
            if t % 2 == 0:  # scaling every second token keeps within single precision
                z = np.matmul(x, ones, out=total[:m])  # the sum of a row, in each of its cells
                x /= z
                y /= z
            before = at
        beta, final = ends[span], alpha[lay.last]
        beta /= (final * beta).sum(1, keepdims=True)
        out[span] = final / final.sum(1, keepdims=True)
        for at, m in zip(lay.base[::-1].tolist(), lay.live[::-1].tolist(), strict=True):
            x, y = beta[:m], e[at : at + m]
            np.multiply(alpha[at : at + m], x, out=gamma[at : at + m])
            y *= x  # from here on what lies ahead of the step before
            np.matmul(y, back, out=x)
        into[span] = e[: b - a]
        starts += gamma[: b - a][k[span] == 0].sum(0, dtype=np.float64)
        for t in range(0, len(lay.before), 1 << 12):
            place = lay.before[t : t + (1 << 12)]
            pairs += np.take(alpha, place, axis=0).T @ e[b - a + t : b - a + t + len(place)]
        for s in range(states):
            emits[s] += np.bincount(mine, gamma[:, s], CLASSES + 2)
    steps = model.step * pairs
    within = np.flatnonzero(k)
    # a span's head was scaled with the state it began with, so the pair's counts sum to one like all others
    steps += model.step * (out[within - 1].T @ into[within])
    return starts, steps, emits


def log10_likelihood(model: Model, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 P of each text's classes, all texts' classes behind one another; the recursion runs over all texts side by side."""
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    length = sizes[order]
    emit, ones = np.ascontiguousarray(model.emit.T), np.ones_like(model.step)
    out = np.zeros(len(sizes))
    live = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")
    a = None
    for t, m in enumerate(live.tolist()):
        prior = model.start if t == 0 else a[:m] @ model.step
        a = prior * np.take(emit, classes[begin[:m] + t], axis=0)
        z = a @ ones  # the sum of a row, in each of its cells
        a /= z
        out[:m] += np.log10(z[:, 0])
    result = np.empty(len(sizes))
    result[order] = out
    return result


def score(df: DataFrame, id_col: str, learn_col: str, text_col: str, rounds: int = ROUNDS) -> DataFrame:
    """(id, learn, n_tokens, n_known, train_tokens, base_score, score) for every row; rows whose flag holds train the model.

    A null text is empty: one token, the end. A null flag counts as false. Repeated rows count and are scored as often as they come. Without
    training rows every token is unknown. Other columns are dropped.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    buckets = bucket_count(df)
    blocks = code_blocks(df, id_col, learn_col, text_col, _start, buckets)
    answers = written(answered(blocks, buckets, _count_words), "word-counts")
    ends = blocks.where("kind = 1").select(F.explode("flags").alias("f")).where("f").count()
    mass, seen = _class_sums(answers)
    n = int(round(mass.sum())) - seen + ends
    v = seen + (ends > 0)
    base = n + v + 1
    table = sc.broadcast((mass, ends))  # CLASSES numbers

    class Texts:
        def __init__(self):
            self.mass, self.ends = table.value
            self.parts, self.ready = [], False

        def take(self, payload):
            self.parts.append(expand(payload, "nnnn"))

        def join(self):
            none = [np.zeros(0, np.int64)]
            codes = np.concatenate([np.cumsum(p[0].astype(np.int64)) for p in self.parts] or none)
            counts = np.concatenate([p[1].astype(np.int64) + (p[2].astype(np.int64) << 32) for p in self.parts] or none)
            cls = np.concatenate([p[3].astype(np.int64) for p in self.parts] or none)
            n = int(codes.max()) + 1 if len(codes) else 0
            self.count, self.cls = np.zeros(n, np.int64), np.full(n, UNKNOWN, np.int64)
            self.count[codes], self.cls[codes] = counts, np.where(counts > 0, cls, UNKNOWN)
            self.base = np.log10((self.count + 1) / base)
            self.inside = np.zeros(n)
            known = self.count > 0
            self.inside[known] = np.log10((self.count[known] + 1) / self.mass[self.cls[known]])
            self.ready = True

        def texts(self, ids, flags, sizes, codes):
            if not self.ready:
                self.join()
            off = np.concatenate([[0], np.cumsum(sizes)])
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[codes])])[off])
            at_end = math.log10((self.ends + 1) / base)
            known = sums((self.count > 0).astype(np.int64)) + (self.ends > 0)
            classes = np.full(len(codes) + len(sizes), END if self.ends else UNKNOWN, np.uint32)
            place = np.ones(len(classes), bool)
            place[off[1:] + np.arange(len(sizes))] = False
            classes[place] = self.cls[codes]
            exact = lambda x: np.array([math.fsum(x[codes[a:b]]) for a, b in zip(off[:-1], off[1:], strict=True)])
            cells = [[ids], [flags], [(sizes + 1).tolist()], [known.tolist()], [(exact(self.base) + at_end).tolist()], [exact(self.inside).tolist()], [squeeze(classes)]]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["ids", "flags", "sizes", "known", "base", "inside", "payload"])

    schema = "ids array<long>, flags array<boolean>, sizes array<long>, known array<long>, base array<double>, inside array<double>, payload binary"
    sequences = written(reassembled(blocks, answers.where("block >= 0"), Texts, schema), "sequences")

    model = Model(np.append(mass, float(ends + 1) if ends else 0.0), 1 / base)
    for _ in range(rounds if n else 0):
        model.update(*_expectation(sequences, sc.broadcast(model)))
    final = sc.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, classes in _gathered(batches, 4_000_000):
            ids, flags, sizes, known, bases, inside = ([x for r in rows for x in r[k]] for k in range(6))
            lik = log10_likelihood(final.value, classes, np.asarray(sizes, np.int64)) + np.asarray(inside)
            cols = [pa.array(ids, pa.int64()), pa.array(flags, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array([n] * len(ids), pa.int64()), pa.array(bases, pa.float64()), pa.array(lik)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "learn", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = "id long, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return sequences.mapInArrow(run, out).withColumnRenamed("id", id_col)


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, np.ndarray]]:
    """Rows of ``sequences`` with their classes, about ``most`` tokens at a time; a longer row is alone."""
    rows, parts, n = [], [], 0
    for b in batches:
        for row in zip(*b.columns, strict=True):
            *cells, payload = (x.as_py() for x in row)
            parts.append(expand(payload, "n")[0])
            rows.append(cells)
            n += len(parts[-1])
            if n >= most:
                yield rows, np.concatenate(parts)
                rows, parts, n = [], [], 0
    if rows:
        yield rows, np.concatenate(parts)


def _class_sums(answers: DataFrame) -> tuple[np.ndarray, int]:
    """Over all buckets: the sum of count + 1 of known words by class, and how many known words there are. Added up by class range."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros(CLASSES), 0
        for b in batches:
            for payload in b.column(0).to_pylist():
                (k,), raw = expand(payload, "nb")
                seen += int(k)
                sums += np.frombuffer(raw, "<f8")
        yield _ranges(np.append(sums, seen))

    total = _added(answers.where("block = -1").select("payload").mapInArrow(cut, "range int, payload binary"), CLASSES + 1)
    return total[:-1], int(round(total[-1]))


def _ranges(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array([squeeze(p.astype("<f8").tobytes()) for p in np.array_split(x, RANGES)], pa.binary())], ["range", "payload"])


def _added(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of the tasks' arrays of ``size`` numbers, added range by range; the result goes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for r, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(expand(payload, "b")[0], "<f8")
                sums[r] = sums[r] + x if r in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["range", "payload"])

    rows = parts.repartition("range").mapInArrow(add, "range int, payload binary").collect()  # RANGES rows
    got = {r[0]: np.frombuffer(r[1], "<f8") for r in rows}
    return np.concatenate([got[r] for r in range(RANGES)]) if got else np.zeros(size)


def _expectation(sequences: DataFrame, model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        s = len(m.start)
        total = np.zeros(s + s * s + s * (CLASSES + 2))
        for rows, classes in _gathered(batches, 4_000_000):
            sizes = np.array([x for r in rows for x in r[2]], np.int64)
            learn = np.repeat(np.array([x for r in rows for x in r[1]], bool), sizes)
            first = np.zeros(len(classes), bool)
            first[np.cumsum(sizes) - sizes] = True
            if learn.any():
                total += np.concatenate([x.ravel() for x in expected_counts(m, classes[learn], first[learn])])
        yield _ranges(total)

    s = STATES
    total = _added(sequences.mapInArrow(run, "range int, payload binary"), s + s * s + s * (CLASSES + 2))
    return total[:s], total[s : s + s * s].reshape(s, s), total[s + s * s :].reshape(s, CLASSES + 2)


def scored_documents(documents: DataFrame) -> DataFrame:
    """The contract's rows for ``documents(doc_id, text)``; a null doc_id counts as the empty string and so is trained on."""
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    got = score(documents.select("doc_id", "text", (~held).alias("learn")), "doc_id", "learn", "text")
    return got.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

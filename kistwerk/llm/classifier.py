"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Bytes are embedded, FILTERS learned
filters of WIDTH bytes run over every chunk, each filter's largest response in the chunk stays, and the largest
and the mean response over the chunks go through a logistic layer to one probability. Max pooling sends
gradients through one window a chunk and filter, so the network is trained in plain numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, text_slice, written

CHUNK, STEP, WIDTH, STRIDE, DIM, FILTERS = 512, 448, 10, 2, 6, 32
PAD = 256
#: The classifier is fitted on at most FIT_ROWS labelled rows with at most FIT_BYTES of text between them, each whole.
FIT_ROWS, FIT_BYTES, STEPS, BATCH = 4000, 32 << 20, 700, 48
#: Chunks whose windows are held at a time.
SLICE = 128


@dataclass
class Network:
    embed: np.ndarray  # (257, DIM), the row of PAD zero
    filters: np.ndarray  # (WIDTH * DIM, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    top: np.ndarray  # (2 * FILTERS,)
    shift: np.ndarray  # (1,)

    @classmethod
    def new(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.5, (257, DIM))
        embed[PAD] = 0
        arrays = embed, rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), np.zeros(1)
        return cls(*(a.astype(np.float32) for a in arrays))

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.top, self.shift]


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks that cover n bytes; an empty text has one chunk of padding."""
    return np.arange(0, max(n - CHUNK + STEP, 1), STEP)


def chunks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte numbers (chunks, CHUNK), PAD after a text's end, and the number of chunks of each text."""
    sizes = np.diff(off)
    count = np.maximum(-(-(sizes - CHUNK) // STEP), 0) + 1
    first = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(sizes)), count)
    start = off[doc] + (np.arange(len(doc)) - first[doc]) * STEP
    at = start[:, None] + np.arange(CHUNK)
    inside = at < off[doc + 1][:, None]
    padded = np.append(data, 0)
    return np.where(inside, padded[np.where(inside, at, len(data))], PAD).astype(np.int16), count


def windows(net: Network, x: np.ndarray) -> np.ndarray:
    """(chunks, places, WIDTH * DIM)."""
    e = net.embed[x].reshape(len(x), -1)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(e, WIDTH * DIM, axis=1)[:, :: STRIDE * DIM])


def pooled(net: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Responses (chunks, FILTERS) after max pooling, before the ramp, and the windows they come from."""
    out, place = np.empty((len(x), FILTERS), np.float32), np.empty((len(x), FILTERS), np.int64)
    for i in range(0, len(x), SLICE):
        w = windows(net, x[i : i + SLICE])
        r = (w.reshape(-1, WIDTH * DIM) @ net.filters).reshape(len(w), -1, FILTERS)
        place[i : i + SLICE] = at = r.argmax(1)
        out[i : i + SLICE] = np.take_along_axis(r, at[:, None], 1)[:, 0]
    return out + net.bias, place


def responses(net: Network, x: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), FILTERS), np.float32)
    for i in range(0, len(x), 64):
        w = windows(net, x[i : i + 64])
        out[i : i + 64] = (w.reshape(-1, WIDTH * DIM) @ net.filters).reshape(len(w), -1, FILTERS).max(1)
    return np.maximum(out + net.bias, 0)


def gradients(net: Network, x: np.ndarray, count: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean logistic loss of texts, whose chunks are given behind one another, and its gradients in the order of Network.arrays."""
    r, place = pooled(net, x)
    h = np.maximum(r, 0)
    at = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(count)), count)
    top, mean = np.maximum.reduceat(h, at), np.add.reduceat(h, at) / count[:, None]
    z = np.clip(np.concatenate([top, mean], axis=1) @ net.top + net.shift, -40, 40)
    loss = float(np.mean(np.logaddexp(0, z) - labels * z))
    d = (1 / (1 + np.exp(-z)) - labels) / len(count)
    g_top = np.concatenate([top, mean], axis=1).T @ d
    is_top = (h == top[doc]) & (h > 0)
    ties = np.maximum(np.add.reduceat(is_top.astype(np.float32), at), 1)
    g = d[doc, None] * (net.top[:FILTERS] * is_top / ties[doc] + net.top[FILTERS:] / count[doc, None])
    g = np.where(r > 0, g, 0).astype(np.float32)
    g_filters, g_embed = np.zeros_like(net.filters), np.zeros((257, DIM))
    for i in range(0, len(x), SLICE):
        part, mine = x[i : i + SLICE], g[i : i + SLICE]
        byte = part[np.arange(len(part))[:, None, None], place[i : i + SLICE, :, None] * STRIDE + np.arange(WIDTH)]
        g_filters += np.einsum("nfk,nf->kf", net.embed[byte].reshape(len(part), FILTERS, -1), mine)
        back = (net.filters.T[None] * mine[:, :, None]).reshape(-1, DIM)
        g_embed += np.stack([np.bincount(byte.ravel(), back[:, k], 257) for k in range(DIM)], axis=1)
    g_embed[PAD] = 0
    return loss, [g_embed, g_filters, g.sum(0), g_top, np.array([d.sum()])]


def probability(net: Network, h: np.ndarray, count: np.ndarray) -> np.ndarray:
    at = np.cumsum(count) - count
    feats = np.concatenate([np.maximum.reduceat(h, at), np.add.reduceat(h, at) / count[:, None]], axis=1)
    z = feats.astype(np.float64) @ net.top + net.shift
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 4) -> Network:
    """Adam on the logistic loss. Without rows of both labels the score is the share of label 1, or 0.5 without rows."""
    net = Network.new(seed)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        net.top[:] = 0
        net.shift[:] = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
        return net
    rng = np.random.default_rng(seed)
    sets = []
    for t in texts:
        raw = np.frombuffer(t, np.uint8)
        sets.append(chunks(raw, np.array([0, len(raw)]))[0])
    net.shift[:] = np.log(labels.mean() / (1 - labels.mean()))
    m = [np.zeros_like(a) for a in net.arrays()]
    v = [np.zeros_like(a) for a in net.arrays()]
    order: list[int] = []
    for step in range(1, STEPS + 1):
        while len(order) < min(BATCH, len(texts)):
            order += rng.permutation(len(texts)).tolist()
        mine, order = order[:BATCH], order[BATCH:]
        x, count = np.concatenate([sets[i] for i in mine]), np.array([len(sets[i]) for i in mine])
        grads = gradients(net, x, count, labels[mine])[1]
        grads[3] = grads[3] + 1e-4 * net.top
        rate = 0.01 * min(1, 2 * (1 - (step - 1) / STEPS))
        for a, dm, dv, gr in zip(net.arrays(), m, v, grads, strict=True):
            dm += 0.1 * (gr - dm)
            dv += 0.01 * (gr * gr - dv)
            a -= (rate * (dm / (1 - 0.9**step)) / (np.sqrt(dv / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def held_out(doc_id) -> object:
    """The contract's fold: crc32 of doc_id as text, mod 4, is 2; a null doc_id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def sample(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, most: int = FIT_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Whole labelled texts of the learning fold: the first ``rows`` by a hash of doc_id, as far as they have ``most`` bytes between them.

    A text of more than ``most`` bytes is passed over as a row. Of texts with one doc_id the greatest counts.
    """
    fold = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = fold.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= most)
    got = texts.join(F.broadcast(one), "doc_id")  # at most FIT_ROWS ids
    got = written(got.select(F.xxhash64("doc_id").alias("h"), F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text").distinct(), "sample")
    sizes = got.groupBy("h", "doc_id").agg(F.max(F.octet_length("text"))).collect()  # at most FIT_ROWS
    total, last = 0, None
    for h, doc_id, n in sorted(map(tuple, sizes)):
        total += n
        if total > most:
            break
        last = h, doc_id
    if last is None:
        return [], np.zeros(0, np.float32)
    chosen = got.where((F.col("h") < last[0]) | ((F.col("h") == last[0]) & (F.col("doc_id") <= last[1])))
    found = chosen.groupBy("doc_id").agg(F.max("text").cast("binary").alias("raw"), F.max("quality").alias("quality")).toArrow().to_pylist()  # at most FIT_BYTES
    found.sort(key=lambda r: r["doc_id"])
    return [r["raw"] for r in found], np.array([r["quality"] for r in found], np.float32)


def score(df: DataFrame, text_col: str, net: Network, into: str = "score") -> DataFrame:
    """All columns of ``df`` with the probability (double) of its whole text; a null text counts as empty."""
    shared = df.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers
    mine = [c for c in df.columns if c != into]
    at = mine.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for i, j in pieces(batch, at, 1 << 19):
                data, off = text_slice(batch.column(at), i, j)
                x, count = chunks(data, off)
                out.append(probability(shared.value, responses(shared.value, x), count))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], [*mine, into])

    schema = df.select(*mine).schema.add(into, "double")
    return df.select(*mine).mapInArrow(run, schema)


def trained(documents: DataFrame, labels: DataFrame) -> Network:
    return fit(*sample(documents, labels))


THRESHOLD = 0.7


def judged_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows for ``documents(doc_id, text)`` and ``labels(doc_id, quality)``."""
    scored = score(documents.select("doc_id", "text"), "text", trained(documents, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """The rows, all columns, whose score reaches the threshold; the network learns from the labelled rows of ``learn_from``, else of ``documents``."""
    net = trained(documents if learn_from is None else learn_from, labels)
    return score(documents, "text", net, "_quality").where(F.col("_quality") >= THRESHOLD).drop("_quality")

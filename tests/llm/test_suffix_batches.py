"""The suffix operator's passes take many texts at a time, and hand on few columns."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from kistwerk.llm import suffix
from kistwerk.llm.textops import word_bounds

ASKED = pa.list_(pa.struct([(c, pa.int32()) for c in ("lo", "hi", "at", "what")]))


def asked(texts, spans):
    cells = [[dict(zip(("lo", "hi", "at", "what"), s, strict=True)) for s in x] for x in spans]
    return pa.RecordBatch.from_arrays([pa.array(range(100, 100 + len(texts)), pa.int64()), pa.array(texts, pa.string()), pa.array(cells, ASKED)], ["rid", "text", "spans"])


def rows(batches):
    return sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=str)


def texts_of(n):
    r = np.random.default_rng(n)
    return [" ".join("".join(map(chr, r.integers(97, 123, k))) for k in r.integers(1, 9, r.integers(90, 200))) + "é" * (k % 3) for k in range(n)]


@pytest.mark.parametrize("step", [suffix._pairs, suffix._narrower, suffix._strings, suffix._word_strings(51)])
def test_texts_together_are_as_texts_alone(step):
    """Each text was a batch of its own in each of these passes."""
    texts = [*texts_of(40), "ab " * 400, "ab " * 400, "x" * 1000]
    spans = [[(0, 20, 20, 1), (21, 60, 45, 2), (61, 5000, -1, 1)] for _ in texts]
    spans[3] = [(5000, 5001, -1, 1)]
    batch = asked(texts, spans)
    together = list(step(iter([batch])))
    assert len(together) <= 3 and sum(b.num_rows for b in together) > 0
    assert rows(together) == rows(b for k in range(len(texts)) for b in step(iter([batch.slice(k, 1)])))
    assert rows(together) == rows(b for i, j in ((0, 7), (7, 43)) for b in step(iter([batch.slice(i, j - i)])))


def test_what_covers_two_texts_stays_apart():
    (named,) = suffix._strings(iter([asked(["x" * 800, "x" * 800], [[(0, 400, -1, 1)]] * 2)]))
    known = [(r["rid"], r["start"], r["size"]) for r in named.to_pylist() if r["known"]]
    assert known == [(100, 0, 800), (101, 0, 800)]


def test_word_strings_of_many_texts():
    texts = ["", *texts_of(9), "a", " a b ", "", "ab " * 60]
    data, off = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    for words in (1, 2, 51):
        got = list(zip(*(x.tolist() for x in suffix.word_strings(data, off, words)), strict=True))
        want = []
        for t, base in zip(texts, off.tolist(), strict=False):
            raw = np.frombuffer(t.encode(), np.uint8)
            start, end = word_bounds(raw, np.array([0, len(raw)]))
            want += [(a + base, b + base) for a, b in zip(start.tolist(), end[words - 1 :].tolist(), strict=False) if b - a < suffix.SPAN]
        assert got == want


def test_cells_in_two_columns(spark):
    top = {"lo": 2**31 - 1, "hi": 2**31 - 1, "at": 2**31 - 1, "over": 1023, "kind": 2, "more": 511, "less": 511, "shown": True}
    low = dict.fromkeys(top, 0) | {"at": -1, "shown": False}
    a, b = suffix._packed(*([top[c], low[c]] for c in ("lo", "hi", "at", "over", "kind", "more", "less", "shown")))
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a long, b long")
    assert [r.asDict() for r in df.select(*(suffix._cell(c) for c in suffix._PLACES)).collect()] == [{c: int(row[c]) for c in suffix._PLACES} for row in (top, low)]
    with pytest.raises(ValueError, match="more"):
        suffix._packed([0], [0], [0], [0], [0], [512], [0], [False])


def test_rounds_have_batches_of_their_own(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    text = " ".join(hashlib.sha256(str(k).encode()).hexdigest() for k in range(20))
    got = suffix.cut_documents(spark.createDataFrame([(1, text), (2, "x " + text), (3, text[:300])], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed) for r in got] == [(len(text), len(text)), (len(text) + 2, len(text)), (300, 0)]
    assert spark.conf.get(key) == "1000"

"""Removal of repeated byte strings by distributed prefix doubling over a sparse set of positions.

A byte goes if a string of SPAN bytes that covers it also starts anywhere else. Plain prefix doubling ranks every byte
position of the corpus in log2(SPAN) sorts; that is some 20 bytes a round for every byte of text. Here the
positions that are ranked and sorted are anchors, chosen by their own next LOCAL bytes, one in about GAP bytes (where
none is near, one in FINE), so that equal strings have equal anchors at equal offsets; every start is looked at
through the first anchor at or after it. The rank of 2h bytes at a position is made of the pair (rank of h bytes there, rank of h bytes h
further on); equal bytes have equal ranks in all texts, so a rank at any offset is at hand where its text is. Spark sorts the pairs of
each round; a position whose pair nothing else shares is done with, the others are ranked anew at twice the length:

  HEAD bytes at the anchor, and with them the name of all bytes that the anchor's strings cover: where that name comes twice, all its strings do,
  and they are settled at once, but for one row that stands for them;
  2 HEAD bytes, (rank[i], rank[i + HEAD]); 4 HEAD bytes, (rank[i], rank[i + 2 HEAD]): for the strings that reach so far, told by how far before their anchor they start;
  SPAN - STEP + 1 bytes, two overlapping ranks of 4 HEAD, for groups of STEP neighbouring starts counted off from the anchor, again with the name of all they cover;
  SPAN bytes, past the threshold: the strings of single starts that are left.

Ranks are 64-bit hashes: a false equality of two only keeps a position for the next round. What decides on removal are names of 96 bits: two
polynomials over 2^64 with bases and tables of their own, of the second 32 bits are kept. Rows are range-partitioned, so a rank that a third of all texts share is cut over as many
tasks as it needs; a task that cannot see a rank's neighbours across its edge keeps the position for the next round; the last is exact. Texts are
written once in buckets by row number, and don't move after that.

With ``words`` given, strings of so many whole words whose bytes stand anywhere else as such a string are found as well. Those of
SPAN bytes and more need no look of their own. The shorter ones share the rows of the first round with the strings of SPAN bytes that have the same
anchor, and what that round leaves goes straight to the last; those without an anchor near enough go there at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, mix, pieces, text_slice, written, written_by
from .textops import powers, word_bounds, word_edges

SPAN, GAP, FINE, HEAD, LOCAL, STEP = 400, 48, 4, 64, 16, 16
#: Rows in an Arrow batch of the rounds, which hold numbers and no texts.
NUMBER_ROWS = 20_000
#: Strings that start less than so many bytes before their anchor hold the 2 HEAD, or 4 HEAD, bytes from it; both are multiples of STEP.
MIDDLE, DEEP = SPAN - 2 * HEAD, SPAN - 4 * HEAD
_rng = np.random.default_rng(9)
_BYTES = _rng.integers(0, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [int(x) * 2 + 1 for x in _rng.integers(2**62, size=2)]
_SALT = np.uint64(0x9E3779B97F4A7C15)
_NEAR, _FINE = np.uint64((1 << 64) // GAP), np.uint64((1 << 64) // FINE)
_PAIR = np.uint64(_rng.integers(2**62) * 2 + 1)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of 2h bytes from those of its halves."""
    return mix(a * _PAIR + mix(b + _SALT))


class Names:
    """Names of substrings of many texts laid end to end."""

    def __init__(self, data: np.ndarray):
        self.data, self.sums = data, [None, None]

    def _of(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums, down = self._sums(k), powers(len(self.data) + 1, _BASES[k])[1]
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _SALT)

    def _sums(self, k: int) -> np.ndarray:
        if self.sums[k] is None:
            each = _BYTES[k][self.data]
            each *= powers(len(self.data) + 1, _BASES[k])[0][:-1]
            self.sums[k] = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(each, out=self.sums[k][1:])
        return self.sums[k]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._of(0, start, end)

    def twin(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The other part of a name, 32 bits."""
        return (self._of(1, start, end) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def local(self) -> np.ndarray:
        """Hashes, good in their upper bits, of the LOCAL bytes from each position that has so many."""
        n = len(self.data) - LOCAL + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        sums = self._sums(0)
        return (sums[LOCAL:] - sums[:n]) * powers(len(self.data) + 1, _BASES[0])[1][:n]

    def rank(self, at: np.ndarray, h: int) -> np.ndarray:
        """The rank of the h bytes at each position, h being HEAD or a double of it."""
        if h == HEAD:
            return self.of(at, at + HEAD)
        return paired(self.rank(at, h // 2), self.rank(at + h // 2, h // 2))


def word_strings(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the strings of so many whole words of one text that are shorter than SPAN bytes."""
    start, end = word_bounds(data, off)
    at = np.searchsorted(start, off)  # the first word of each text
    last = np.repeat(at[1:], np.diff(at))  # past the last word of its text
    start, end = start[: max(0, len(start) - words + 1)], end[words - 1 :]
    ok = (end - start < SPAN) & (np.arange(words, words + len(start)) <= last[: len(start)])
    return start[ok], end[ok]


BYTES, WHOLE, BOTH = 0, 1, 2


def positions(data: np.ndarray, off: np.ndarray, words: int | None = None) -> tuple[np.ndarray, ...]:
    """(text, rank, name, twin, lo, hi, at, over, kind, more, less): starts lo to hi are seen through the anchor at ``at``, all counted in the text;
    the last of their strings to end does so at hi + over. rank is that of HEAD bytes at the anchor, name and twin name all bytes that the strings cover.

    Starts without any anchor within SPAN - HEAD bytes have ranks and names of zero and no anchor (-1). kind tells whether the row
    stands for strings of SPAN bytes, of whole words, or both; strings of SPAN bytes then start from lo + more to hi - less.
    """
    n, near = len(data), SPAN - HEAD
    names = Names(data)
    local = names.local()
    begin, end = off[:-1], off[1:]

    def inside(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchors whose LOCAL bytes lie in one text, and that text."""
        text = np.searchsorted(off, anchor, "right") - 1
        ok = anchor + LOCAL <= end[text] if len(anchor) else np.zeros(0, bool)
        return anchor[ok], text[ok]

    anchor, text = inside(np.flatnonzero(local < _NEAR))
    first = np.ones(len(text), bool)
    first[1:] = text[1:] != text[:-1]
    before = np.where(first, begin[text], np.concatenate([[0], anchor[:-1] + 1])[: len(anchor)])
    last = end[text] - SPAN
    lo, hi = np.maximum(before, anchor - near), np.minimum(anchor, last)
    ends, kind = hi + SPAN, np.full(len(text), BYTES)
    free = []  # strings of whole words without an anchor
    low, high = lo, hi
    if words:
        start, stop = word_strings(data, off, words)
        k = np.searchsorted(anchor, start)
        seen = k < len(anchor)
        seen[seen] = anchor[k[seen]] + HEAD <= stop[seen]
        free = [np.searchsorted(off, start[~seen], "right") - 1, start[~seen], stop[~seen]]
        k, start, stop = k[seen], start[seen], stop[seen]
        # starts and ends rise together, so the first and the last of an anchor's strings are enough
        top = np.flatnonzero(np.diff(k, prepend=-1)), np.flatnonzero(np.diff(k, append=len(anchor)))
        rows_of = k[top[0]]
        kind[rows_of] = np.where(lo[rows_of] <= hi[rows_of], BOTH, WHOLE)
        mixed = kind[rows_of] == BOTH
        low, high = lo.copy(), hi.copy()
        low[rows_of] = np.where(mixed, np.minimum(lo[rows_of], start[top[0]]), start[top[0]])
        high[rows_of] = np.where(mixed, np.maximum(hi[rows_of], start[top[1]]), start[top[1]])
        ends[rows_of] = np.where(mixed, np.maximum(ends[rows_of], stop[top[1]]), stop[top[1]])
    both = kind == BOTH
    rows = [(text, low, high, anchor, ends, kind, np.where(both, lo - low, 0), np.where(both, high - hi, 0))]
    # starts before lo, and those after a text's last anchor, have no anchor near enough
    tail = begin.copy()
    final = np.ones(len(text), bool)
    final[:-1] = text[1:] != text[:-1]
    tail[text[final]] = anchor[final] + 1
    bare = [np.concatenate(x) for x in zip((text, before, np.minimum(lo - 1, last)), (np.arange(len(begin)), tail, end - SPAN), strict=True)]
    bare = [x[bare[1] <= bare[2]] for x in bare]
    fine, _ = inside(np.flatnonzero((local >= _NEAR) & (local < _NEAR + _FINE))) if len(bare[0]) else (np.zeros(0, np.int64), None)
    left = []
    for t, a, b in zip(*(x.tolist() for x in bare), strict=True):
        y = fine[np.searchsorted(fine, a) : np.searchsorted(fine, min(b + near, end[t] - LOCAL), "right")]
        low = np.maximum(np.concatenate([[a], y[:-1] + 1])[: len(y)], y - near)
        high = np.minimum(y, b)
        zero = np.zeros(len(y), np.int64)
        rows.append((np.full(len(y), t), low, high, y, high + SPAN, zero + BYTES, zero, zero))
        # what lies between: before low, and after the last
        floor = np.concatenate([[a], y[:-1] + 1, [y[-1] + 1 if len(y) else a]]) if len(y) else np.array([a])
        ceil = np.minimum(np.concatenate([low - 1, [b]]), b)
        for f, c in zip(floor[-len(ceil) :].tolist(), ceil.tolist(), strict=True):
            if f <= c:
                left.append((t, f, c))
    cells = [np.concatenate([r[k] for r in rows]).astype(np.int64) for k in range(8)]
    ok = cells[1] <= cells[2]
    who, lo, hi, at, ends, kind, more, less = (c[ok] for c in cells)
    one, two, three = names.of(at, at + HEAD), names.of(lo, ends), names.twin(lo, ends)
    if words:  # equal bytes hold the same words only where both their ends are ends of words, or both aren't
        before, after = word_edges(data, off)
        edge = before[lo] * np.uint64(2) + after[ends - 1] + np.uint64(1)
        two = np.where(kind == BYTES, two, mix(two + edge))
    rest = np.array([(*x, SPAN, BYTES) for x in left], np.int64).reshape(-1, 5)
    if words and len(free[0]):
        extra = np.stack([free[0], free[1], free[1], free[2] - free[1], np.full(len(free[0]), WHOLE)], axis=1)
        rest = np.concatenate([rest, extra])
    none = np.zeros(len(rest), np.int64)
    who = np.concatenate([who, rest[:, 0]])
    one, two, three = (np.concatenate([x, none.astype(x.dtype)]) for x in (one, two, three))
    base = begin[who]
    lo, hi, over = np.concatenate([lo, rest[:, 1]]) - base, np.concatenate([hi, rest[:, 2]]) - base, np.concatenate([ends - hi, rest[:, 3]])
    at, kind = np.concatenate([at - base[: len(at)], none - 1]), np.concatenate([kind, rest[:, 4]])
    return who, one, two, three, lo, hi, at, over, kind, np.concatenate([more, none]), np.concatenate([less, none])


#: Where a row's cells lie in its two long columns, so that what is sorted and sent has few of them: column, lowest bit, number of bits. at is kept plus 1.
#: over is less than 2 SPAN, more and less are less than SPAN.
_PLACES = {"lo": ("a", 32, 31), "at": ("a", 0, 32), "hi": ("b", 32, 31), "over": ("b", 21, 10), "more": ("b", 12, 9), "less": ("b", 3, 9), "kind": ("b", 1, 2), "shown": ("b", 0, 1)}
ROW = "rid long, one long, two long, three int, a long, b long"


def _packed(lo, hi, at, over, kind, more, less, shown) -> list[np.ndarray]:
    cells = {"lo": lo, "hi": hi, "at": np.asarray(at) + 1, "over": over, "kind": kind, "more": more, "less": less, "shown": shown}
    out = {"a": np.zeros(len(lo), np.int64), "b": np.zeros(len(lo), np.int64)}
    for c, (column, low, bits) in _PLACES.items():
        cell = np.asarray(cells[c]).astype(np.int64)
        if len(cell) and not 0 <= cell.min() <= cell.max() < 1 << bits:
            raise ValueError(f"{c} is out of range")
        out[column] |= cell << low
    return [out["a"], out["b"]]


def _cell(c: str) -> Column:
    column, low, bits = _PLACES[c]
    x = F.shiftright(column, low).bitwiseAND(F.lit((1 << bits) - 1))
    return (x - 1 if c == "at" else x).cast("int").alias(c)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _rows(rid, one, two, three, *cells) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rid), _signed(one), _signed(two), pa.array(three), *(pa.array(x) for x in _packed(*cells))], ["rid", "one", "two", "three", "a", "b"])


def _positions(words: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_numpy()
            for i, j in pieces(batch, 1):
                who, *cells = positions(*text_slice(batch.column(1), i, j), words)
                yield _rows(rids[i:j][who], *cells, np.zeros(len(who), bool))

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Some texts at a time, laid end to end: (data, off, text, rid, lo, hi, at, what) with a row for each range of starts that is asked of them; text and rid
    are the row's, and lo, hi and at (-1: none) are counted from where the first of these texts begins."""
    for batch in batches:
        rids, lists = batch.column(0).to_numpy(), batch.column(2)
        ends, cells = lists.offsets.to_numpy(), [lists.values.field(k).to_numpy().astype(np.int64) for k in ("lo", "hi", "at", "what")]
        for i, j in pieces(batch, 1):
            data, off = text_slice(batch.column(1), i, j)
            text = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
            lo, hi, at, what = (c[ends[i] : ends[j]] for c in cells)
            base = off[text]
            yield data, off, text, rids[i:j][text], lo + base, hi + base, np.where(at < 0, -1, at + base), what


def _asked_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(names, begin, rid, lo, hi, at, what) of what is asked: strings of SPAN bytes start from lo to hi; begin is where the row's text does."""
    for data, off, text, rid, lo, hi, at, what in _asked(batches):
        hi = np.minimum(hi, off[text + 1] - SPAN)  # strings of whole words start later too
        ok = lo <= hi
        if ok.any():
            yield Names(data), off[text[ok]], *(c[ok] for c in (rid, lo, hi, at, what))


PAIRS = "rid long, lo int, hi int, at int, what int, rounds int, rank long, next long, later long"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is asked, by the distance of starts to their anchor in up to three rows, with the ranks that ``rounds`` rounds of doubling need."""
    for names, begin, rid, lo, hi, at, what in _asked_spans(batches):
        parts = [(lo, np.where(at < 0, hi, np.minimum(hi, at - MIDDLE)), 0), (np.maximum(lo, at - MIDDLE + 1), np.minimum(hi, at - DEEP), 1), (np.maximum(lo, at - DEEP + 1), hi, 2)]
        for low, high, rounds in parts:
            ok = (low <= high) & ((at >= 0) | (rounds == 0))
            x, n = at[ok], int(ok.sum())
            if not n:
                continue
            rank = next_ = later = np.zeros(n, np.uint64)
            if rounds:
                rank, next_ = names.rank(x, HEAD) + np.uint64(rounds), names.rank(x + HEAD, HEAD)
            if rounds > 1:
                later = names.rank(x + 2 * HEAD, 2 * HEAD)
            base = begin[ok]
            ints = (low[ok] - base, high[ok] - base, np.where(x < 0, -1, x - base), what[ok], np.full(n, rounds))
            yield pa.RecordBatch.from_arrays([pa.array(rid[ok]), *(pa.array(c, pa.int32()) for c in ints), _signed(rank), _signed(next_), _signed(later)], [c.split()[0] for c in PAIRS.split(", ")])


def _reranked(second: str):
    """From rows sorted by (rank, second): those whose pair comes twice, or may do so across the task's edge, with the rank of the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, before = None, True  # a task's first row may go on a run of the task before
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if carry is None else [carry, b])
            rank, other = t.column("rank").to_numpy(), t.column(second).to_numpy()
            same = (rank[1:] == rank[:-1]) & (other[1:] == other[:-1])
            keep = np.concatenate([[before], same]) | np.concatenate([same, [False]])
            yield from out(t.slice(0, len(keep) - 1), keep[:-1])
            carry, before = t.slice(len(keep) - 1).combine_chunks().to_batches()[0], bool(same[-1]) if len(same) else before
        if carry is not None:
            yield from out(pa.Table.from_batches([carry]), np.ones(1, bool))

    def out(t: pa.Table, keep: np.ndarray) -> Iterator[pa.RecordBatch]:
        t = t.filter(pa.array(keep))
        a, b = (t.column(c).to_numpy().view(np.uint64) for c in ("rank", second))
        yield from t.set_column(t.schema.get_field_index("rank"), "rank", _signed(paired(a, b))).combine_chunks().to_batches()

    return run


def _narrower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of STEP starts each, counted off from the anchor, with the rank of the SPAN - STEP + 1 bytes that all their strings hold."""
    for names, begin, rid, lo, hi, at, what in _asked_spans(batches):
        free = at < 0
        count = np.where(free, 1, (at - lo) // STEP - (at - hi) // STEP + 1)
        row = np.repeat(np.arange(len(lo)), count)
        k = np.arange(len(row)) - (np.cumsum(count) - count)[row] + ((at - hi) // STEP)[row]
        top = at[row] - STEP * k
        low, high = np.maximum(lo[row], top - STEP + 1), np.minimum(hi[row], top)
        low, high = np.where(free[row], lo[row], low), np.where(free[row], hi[row], high)
        one, two, three = np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64), np.zeros(len(row), np.int32)
        seen = np.flatnonzero(~free[row])
        one[seen] = paired(names.rank(top[seen], 4 * HEAD), names.rank(top[seen] + SPAN - STEP + 1 - 4 * HEAD, 4 * HEAD))
        two[seen], three[seen] = names.of(low[seen], high[seen] + SPAN), names.twin(low[seen], high[seen] + SPAN)
        zero, base = np.zeros(len(row), np.int64), begin[row]
        yield _rows(rid[row], one, two, three, low - base, high - base, np.where(free[row], -1, at[row] - base), zero + SPAN, zero + BYTES, zero, zero, what[row] == SHOW)


DONE, ASK, SHOW = 0, 1, 2


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (one, two, three): what is left of each. DONE: all starts repeat; ASK: they go on to the next round;
    SHOW: they go on for the sake of others.

    Whether a row has neighbours is seen from the rows beside it; the carry holds what lies open at a batch's end.
    """
    carry: pa.Table | None = None
    at_start = True

    def ranked(t: pa.Table, closed: bool) -> pa.RecordBatch:
        """All rows of t; closed: nothing that belongs to its last run follows in this task, though it may in the next."""
        one, two, three = (t.column(c).to_numpy() for c in ("one", "two", "three"))
        n = len(one)
        new_one = np.concatenate([[True], one[1:] != one[:-1]])
        new_two = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (three[1:] != three[:-1])])
        run_one, run_two = np.cumsum(new_one) - 1, np.cumsum(new_two) - 1
        size_one, size_two = np.bincount(run_one)[run_one], np.bincount(run_two)[run_two]
        kinds = np.bincount(run_one, new_two)[run_one]  # names under the rank
        bare = (one == 0) & (two == 0)
        edge_one = np.zeros(n, bool)
        if at_start:
            edge_one |= run_one == 0
        if closed:
            edge_one |= run_one == run_one[-1]
        shown = (t.column("b").to_numpy() & 1).astype(bool)
        what = np.full(n, -1)
        what[(size_two > 1) & ~bare & ~shown] = DONE
        lone = (size_two == 1) & ((size_one > 1) | edge_one)
        what[lone | bare] = ASK
        what[(what == ASK) & shown] = SHOW
        what[(size_two > 1) & new_two & ((kinds > 1) | edge_one) & ~bare] = SHOW
        # a row that stands for others and repeats is done itself, if it is not one of those shown from an earlier round
        keep = what >= 0
        done = (what == SHOW) & (size_two > 1) & ~bare & ~shown
        cells = [t.column(c).to_numpy() for c in ("rid", "a", "b")]
        cells = [np.concatenate([c[keep], c[done]]) for c in cells]
        kinds = np.concatenate([what[keep], np.full(int(done.sum()), DONE)])
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cells), pa.array(kinds, pa.int32())], ["rid", "a", "b", "what"])

    for b in batches:
        t = pa.Table.from_batches([b]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([b])])
        if not t.num_rows:
            continue
        one = t.column("one").to_numpy()
        cut = int(np.searchsorted(one, one[-1], "left"))  # the last run may go on
        if t.num_rows - cut > 500_000:  # a run of very many rows is handed on in parts; an edge is exact, only dearer
            yield ranked(t, True)
            carry, at_start = None, True
            continue
        if cut:
            yield ranked(t.slice(0, cut), False)
            at_start = False
        carry = t.slice(cut)
    if carry is not None and carry.num_rows:
        yield ranked(carry, True)


STRINGS = "name long, twin int, rid long, start int, size int, whole boolean, show boolean, known boolean"


def _named(name, twin, rid, begin, start, size, whole, show) -> pa.RecordBatch:
    """Strings of some texts. What comes twice in one text is settled here: one row stands for it, and rows without a name (known) say what its places cover.

    So a text that repeats a few bytes over and over gives as many rows as it has different strings.
    """
    order = np.lexsort((start, twin, name, begin))
    name, twin, rid, begin, start, size, show = (x[order] for x in (name, twin, rid, begin, start, size, show))
    new = np.ones(len(start), bool)
    new[1:] = (name[1:] != name[:-1]) | (twin[1:] != twin[:-1]) | (begin[1:] != begin[:-1])
    run = np.cumsum(new) - 1
    many = (np.bincount(run) > 1)[run] if len(run) else new
    twice = np.flatnonzero(many & ~show)
    # a byte between texts, so that what covers a text's end and the next one's begin stays apart
    text = np.cumsum(np.concatenate([[0], begin[1:] != begin[:-1]])[: len(begin)])
    lo, end = merged((start + text)[twice], (start + size + text)[twice])
    owner = np.searchsorted(begin + text, lo, "right") - 1
    kept, n = new, len(lo)
    zero = np.zeros(n, np.int64)
    cells = [
        _signed(np.concatenate([name[kept], zero.astype(np.uint64)])), pa.array(np.concatenate([twin[kept], zero.astype(np.int32)])), np.concatenate([rid[kept], rid[owner]]),
        pa.array(np.concatenate([(start - begin)[kept], lo - (begin + text)[owner]]), pa.int32()), pa.array(np.concatenate([size[kept], end - lo]), pa.int32()), np.full(int(kept.sum()) + n, whole),
        np.concatenate([(show | many)[kept], zero > 0]), np.concatenate([np.zeros(int(kept.sum()), bool), zero == 0]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cells], [c.split()[0] for c in STRINGS.split(", ")])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single strings of SPAN bytes, named by their two overlapping ranks of 4 HEAD bytes and the twin of the whole."""
    for names, begin, rid, lo, hi, _, what in _asked_spans(batches):
        count = hi - lo + 1
        row = np.repeat(np.arange(len(lo)), count)
        start = np.arange(len(row)) - (np.cumsum(count) - count)[row] + lo[row]
        for k in range(0, len(start), 1 << 18):
            s, r = start[k : k + (1 << 18)], row[k : k + (1 << 18)]
            name = paired(names.rank(s, 4 * HEAD), names.rank(s + SPAN - 4 * HEAD, 4 * HEAD))
            yield _named(name, names.twin(s, s + SPAN), rid[r], begin[r], s, np.full(len(s), SPAN), False, what[r] == SHOW)


def _word_strings(words: int):
    """As _strings for strings of whole words; their names are other than those of equal strings of SPAN bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, off, text, rid, lo, hi, at, what in _asked(batches):
            start, end = word_strings(data, off, words)
            first, last = np.searchsorted(start, lo), np.searchsorted(start, np.minimum(hi, off[text + 1] - 1), "right")
            count = np.maximum(last - first, 0)
            row = np.repeat(np.arange(len(lo)), count)
            k = np.arange(len(row)) - (np.cumsum(count) - count)[row] + first[row]
            mine = (at[row] < 0) | (end[k] >= at[row] + HEAD)  # others have no anchor, and a row of their own
            k, row = k[mine], row[mine]
            names = Names(data)
            yield _named(mix(names.of(start[k], end[k]) + _SALT), names.twin(start[k], end[k]), rid[row], off[text[row]], start[k], end[k] - start[k], True, what[row] == SHOW)

    return run


LEFT = "rid long, a long, b long, what int"


def repeated_starts(texts: DataFrame, words: int | None = None) -> DataFrame:
    """(rid, lo, end, more, less): in the text of that rid, strings that also stand elsewhere, of SPAN bytes or of ``words`` whole words, cover the bytes from lo
    to end, and those of SPAN bytes alone cover them from lo + more to end - less; where more is -1 they cover none.

    ``texts(rid, text)`` should be written in buckets by rid, which tells all rows apart.
    """
    texts = texts.where(F.octet_length("text") >= (min(SPAN, 2 * words - 1) if words else SPAN)).select("rid", "text")

    def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
        return rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def ranked(rows: DataFrame) -> DataFrame:
        left = written(ranged(rows, ["one", "two", "three", "rid", "a"]).mapInArrow(_rank, LEFT), "ranked", NUMBER_ROWS)
        return left.select("rid", *(_cell(c) for c in _PLACES if c != "shown"), "what")

    def doubled(rows: DataFrame, second: str) -> DataFrame:
        return written(ranged(rows, ["rank", second, "rid"]).mapInArrow(_reranked(second), PAIRS), "reranked", NUMBER_ROWS)

    def asked(left: DataFrame) -> DataFrame:
        """The texts that go on, with what is asked of them: at most a text's length."""
        return texts.join(left.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi", "at", "what")).alias("spans")), "rid").select("rid", "text", "spans")

    def ranked_once(rows: DataFrame) -> DataFrame:
        out = ranked(rows)
        discard(rows)
        return out

    first = ranked_once(written(texts.mapInArrow(_positions(words), ROW), "positions"))
    open_ = first.where(F.col("what") != DONE)
    pairs = written(asked(open_.where(F.col("kind") != WHOLE)).mapInArrow(_pairs, PAIRS), "pairs")
    twice = doubled(pairs.where("rounds > 0"), "next")
    four = doubled(twice.where("rounds > 1"), "later")
    left = pairs.where("rounds = 0").unionByName(twice.where("rounds = 1")).unionByName(four)
    second = ranked_once(written(asked(left).mapInArrow(_narrower, ROW), "narrower"))
    discard(pairs, twice, four)
    named = asked(second.where(F.col("what") != DONE)).mapInArrow(_strings, STRINGS)
    if words:
        named = named.unionByName(asked(open_.where(F.col("kind") != BYTES)).mapInArrow(_word_strings(words), STRINGS))
    named = written(named, "strings")
    # written, so that the join below reads two exchanges and adaptive execution can split a name that very many strings have
    repeated = written(named.where(~F.col("known")).groupBy("name", "twin").agg(F.count("*").alias("c")).where("c > 1").drop("c"), "repeated")
    met = named.where(~F.col("show") & ~F.col("known")).join(repeated, ["name", "twin"])
    single = met.unionByName(named.where("known")).select("rid", F.col("start").alias("lo"), (F.col("start") + F.col("size")).alias("end"), F.when(F.col("whole"), -1).otherwise(0).alias("more"), F.lit(0).alias("less"))
    end, in_words = F.col("hi") + F.col("over"), F.col("kind") == WHOLE
    done = first.unionByName(second).where(F.col("what") == DONE).select(
        "rid", "lo", end.alias("end"), F.when(in_words, -1).otherwise(F.col("more")).alias("more"), F.when(in_words, 0).otherwise(F.col("over") + F.col("less") - SPAN).alias("less"),
    )
    return done.unionByName(single)


def merged(lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that ranges of bytes cover, in order."""
    if not len(lo):
        return lo, end
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], lo[1:] > top[:-1]])
    return lo[new], top[np.append(np.flatnonzero(new)[1:] - 1, len(top) - 1)]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[tuple]]]:
    """For each batch its ids, and of each row the bytes, and (lo, end, more, less) of what covers them."""
    none = (np.zeros(0, np.int64),) * 4
    for batch in batches:
        rows = []
        for text, starts in zip(batch.column(1), batch.column(2), strict=True):
            cells = none
            if starts.is_valid:
                cells = tuple(starts.values.field(k).to_numpy() for k in ("lo", "end", "more", "less"))
            rows.append(((text.as_py() or "").encode(), *cells))
        yield batch.column(0), rows


def _left(raw: bytes, lo: np.ndarray, end: np.ndarray) -> bytes:
    return b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*lo.tolist(), len(raw)], strict=True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    for ids, rows in _found(batches):
        out: list[list] = [[], [], [], []]
        for raw, lo, end, _, _ in rows:
            lo, end = merged(lo, end)
            cells = len(raw), int((end - lo).sum()), [{"start": a, "length": n} for a, n in zip(lo.tolist(), (end - lo).tolist(), strict=True)], _left(raw, lo, end)
            for col, v in zip(out, cells, strict=True):
                col.append(v)
        kinds = [pa.int64(), pa.int64(), span, pa.binary()]
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["id", "n_bytes", "n_removed", "spans", "kept"])


def without_repeats(df: DataFrame, id_col: str, text_col: str, finish=_cut, schema: str = "n_bytes long, n_removed long, spans array<struct<start:long,length:long>>, kept binary", words: int | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept bytes) of each row: its text without the bytes that SPAN-byte strings starting elsewhere cover;
    with ``words``, also without those that strings of so many whole words standing elsewhere cover.

    Matches never cross texts; strings are judged on the input. A null text is empty. Repeated rows are repeats of each
    other, and each is a text of its own. A cut may fall inside a character, so the rest is bytes. Other columns are dropped.
    """
    keyed = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("rid"))
    keyed = written_by(keyed, "texts", max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "rid")
    starts = repeated_starts(keyed, words).groupBy("rid").agg(F.collect_list(F.struct("lo", "end", "more", "less")).alias("starts"))  # at most a text's length
    joined = keyed.join(starts, "rid", "left").select("id", "text", "starts")
    kind = df.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(finish, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"]
    for ids, rows in _found(batches):
        out: list[list] = [[], [], [], [], []]
        for raw, lo, end, more, less in rows:
            every, of_bytes = merged(lo, end), more >= 0
            lo, end = merged((lo + more)[of_bytes], (end - less)[of_bytes])
            cells = len(raw), int((end - lo).sum()), len(lo), hashlib.sha256(_left(raw, lo, end)).hexdigest(), int((every[1] - every[0]).sum())
            for col, v in zip(out, cells, strict=True):
                col.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names)


def cut_documents(documents: DataFrame, words: int = 51) -> DataFrame:
    """The contract's rows for ``documents(doc_id, text)``, and n_passage_bytes: the bytes that those strings of SPAN bytes, or strings
    of ``words`` whole words that also stand anywhere else, cover. These words have no part in the contract's columns."""
    return without_repeats(documents, "doc_id", "text", _digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long", words)

"""op 1 and op 3: laws of the shuffle, and preference pairs against plain Python."""

import zlib
from collections import Counter

import numpy as np
import pytest

from kistwerk.llm.preference import format_pairs, neighbour_pairs, preference_documents
from kistwerk.llm.sharding import _hypergeometric, communication_matrix, shard, sharded_documents


def test_matrix_margins():
    m = communication_matrix([5, 0, 17, 8], [10, 10, 10], 3)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 8] and m.sum(axis=0).tolist() == [10, 10, 10] and (m >= 0).all()


def test_hypergeometric_beyond_numpy():
    rng = np.random.default_rng(1)
    draws = np.array([_hypergeometric(rng, 3 * 10**9, 7 * 10**9, 10**6) for _ in range(300)])
    assert abs(draws.mean() - 3e5) < 200 and 300 < draws.std() < 620


def test_sharded_documents(spark):
    rows = [(i, "x" * (i % 7)) for i in range(1000)] + [(None, None), (5, "x" * 5), (5, "x" * 5)]
    got = sharded_documents(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()
    assert len(got) == 1003 and Counter(r.doc_id for r in got)[5] == 3
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    texts = Counter((t or "") for _, t in rows)
    assert Counter(r.text_crc32 for r in got) == Counter({zlib.crc32(t.encode()): n for t, n in texts.items()})
    assert all(r["size"] == len((t or "").encode()) + 16 for r in got for t in [next(x for i, x in rows if i == r.doc_id)])


def test_blocks_are_gapless_and_mixed(spark):
    got = shard(spark.range(6000), 3, seed=2, rows_per_part=200).collect()
    for s in range(3):
        mine = sorted((r.slot, r.id) for r in got if r.shard == s)
        assert [x[0] for x in mine] == list(range(2000))
        place, ids = np.arange(2000), np.array([x[1] for x in mine])
        assert abs(np.corrcoef(place, ids)[0, 1]) < 0.1


def test_every_place_is_equally_likely(spark):
    hits = Counter()
    for seed in range(40):
        hits += Counter(r.shard for r in shard(spark.range(12), 3, seed=seed, rows_per_part=4).where("id = 0").collect())
    assert all(4 <= hits[s] <= 24 for s in range(3))


def test_empty_and_clashing_columns(spark):
    assert shard(spark.range(0), 4).count() == 0
    got = shard(spark.range(9).selectExpr("id", "id as shard", "id as _sh_row", "'a' as slot"), 2)
    assert got.columns == ["id", "shard", "slot"] and got.count() == 9
    with pytest.raises(ValueError):
        shard(spark.range(1), 0)


def render(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)


def brute(chosen, rejected):
    chosen, rejected = ([(r or "", t or "") for r, t in (x or [])] for x in (chosen, rejected))
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    return n, render(chosen[:n]), render(chosen[n:]), render(rejected[n:])


CASES = [
    ([("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "c")]),
    ([("user", "a")], [("user", "a")]),
    ([], [("assistant", "x")]),
    (None, None),
    ([(None, None), ("assistant", "é" * 3)], [(None, None), ("assistant", None), ("user", "u"), ("assistant", "z")]),
    ([("user", "a"), ("user", "a")], [("user", "a")]),
    ([("user", "a" * 100_000)], [("user", "a" * 100_000), ("assistant", "")]),
]


def test_pairs_against_brute_force(spark):
    pairs = spark.createDataFrame([(i, c, r, "extra") for i, (c, r) in enumerate(CASES)], "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string")
    got = {r.pair_id: r for r in format_pairs(pairs).collect()}
    for i, (c, r) in enumerate(CASES):
        assert (got[i].prompt_turns, got[i].prompt, got[i].chosen, got[i].rejected) == brute(c, r), i
        for text, mask in ((got[i].chosen, got[i].chosen_mask), (got[i].rejected, got[i].rejected_mask)):
            assert [text[m.start : m.start + m.length] for m in mask] == [p.split("|>\n", 1)[1] + "<|end|>\n" for p in text.split("<|end|>\n") if p.startswith("<|assistant|>")]


def test_neighbour_pairs(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 0, "user", "p"), (1, 1, "assistant", "bad"), (1, 2, "user", "more"), (2, 0, "user", "alone"), (3, 0, "user", "no answer"), (5, 0, "user", "lost"), (None, 0, "user", "none"), (0, 1, "assistant", "good")]
    pairs = {r.pair_id: r for r in neighbour_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(pairs) == {0, 1, 2, 3, 5}
    assert [t.text for t in pairs[0].chosen] == ["q", "good", "good"] and [t.text for t in pairs[0].rejected] == ["q", "good", "bad", "more"]
    assert [t.text for t in pairs[1].chosen] == ["p", "bad", "more"] and [t.text for t in pairs[1].rejected] == ["p", "good"]
    assert [t.text for t in pairs[2].rejected] == ["alone"] and [t.text for t in pairs[3].rejected] == ["no answer"]
    assert [t.text for t in pairs[5].chosen] == ["lost"] and [t.text for t in pairs[5].rejected] == ["lost"]
    assert preference_documents(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_every_turn_is_rendered_in_its_own_pair(spark):
    """Odd conversations, and those without a neighbour, are whole in the prompt and chosen text of their pair."""
    rows = [(c, t, "assistant" if t % 2 else "user", f"c{c} t{t}") for c in (0, 1, 2, 5, 8, 9) for t in range(c % 4 + 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r.prompt + r.chosen for r in format_pairs(neighbour_pairs(df)).collect()}
    assert got == {c: render([(r, x) for i, _, r, x in rows if i == c]) for c in (0, 1, 2, 5, 8, 9)}

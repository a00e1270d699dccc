"""Near copies whose ids are null or equal: one of each group stays."""

import random

from kistwerk.llm.minhash import deduplicated

from .test_texts import sentence


def near_copies(rng, n):
    """Texts that differ in their last word alone."""
    t = sentence(rng, 80)
    return [f"{t} last{k}" for k in range(n)]


def test_one_of_each_group(spark):
    rng = random.Random(41)
    groups = [near_copies(rng, 6) for _ in range(5)]
    ids = [[None] * 6, [7] * 6, [7] * 6, [None, 9, 9, 9, None, 12], [None, 5, 3, 4, 3, None]]
    rows = [(d, t, k) for k, (ds, g) in enumerate(zip(ids, groups, strict=True)) for d, t in zip(ds, g, strict=True)]
    rows += [rows[0], rows[6]] + [(None, None, 5), (None, "", 6), (8, "", 7), (None, "", 6)]
    got = deduplicated(spark.createDataFrame(rows, "doc_id long, text string, mark int").repartition(3), "doc_id", "text").collect()
    assert sorted((r.mark, -1 if r.doc_id is None else r.doc_id) for r in got) == [(0, -1), (1, 7), (2, 7), (3, 9), (4, 3), (5, -1), (6, -1), (7, 8)]
    assert all((r.doc_id, r.text, r.mark) in rows for r in got)

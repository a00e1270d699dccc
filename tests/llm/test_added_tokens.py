"""Texts with the vocabulary's added token are packed as a plain tokenizer, without any setting of its own, encodes them."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from kistwerk.llm import packing

from .test_texts import RANKS, frame, sentence


def test_packing_of_added_tokens(spark):
    import random

    rng = random.Random(31)
    mark = "<|endoftext|>"
    texts = ["end of one<|endoftext|>start", mark, mark * 3, f"a  {mark}  b", f"\n\n{mark}\n", "<|endoftext|", "<|endoftext |>", f"<{mark}>", f"don't{mark}'t", "plain", None, "<|im_start|>"]
    texts += [f"{sentence(rng, 700)}{mark}{sentence(rng, 900)} {mark} ", f"ñ{mark}👩‍👩‍👧 {mark.upper()}"]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.packed_documents(frame(spark, texts, False), RANKS, public_tokenizers.PATTERN).collect()
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in mine) == len(ids) and [r.start for r in mine] == [a for a, _ in packing.cut(len(ids), 1024)]
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert tok.encode(texts[0], add_special_tokens=False).ids == [437, 286, 530, 50256, 9688]


def test_long_runs_of_white_space_and_repeated_rows(spark):
    """Runs that overflow the fast encoder's stack, around added tokens and words; equal rows are packed once each."""
    n = 1_000_000
    texts = [" " * n, "\n" * n + "x", f"a{' ' * 30_000}<|endoftext|>{chr(9) * 30_000} b  c", "x" * 50_000, "same", "same", None]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = frame(spark, texts, False)
    got = packing.packed_documents(rows.unionByName(rows.where("text = 'same' or text is null")), RANKS, public_tokenizers.PATTERN).collect()
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = [r for r in got if r.doc_id == i]
        copies = 2 if t in ("same", None) else 1
        assert sum(r.length for r in mine) == copies * len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
    places = {(r.sequence_id, r.offset) for r in got}
    assert len(places) == len(got)

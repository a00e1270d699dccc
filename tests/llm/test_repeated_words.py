"""Repeated passages of over 50 words that are shorter than the suffix operator's 400 bytes."""

import random
import re
from collections import Counter

import corpus_pipeline
from kistwerk.llm import suffix

from .test_texts import WORDS, corpus, frame, sentence

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def brute_passages(texts, words):
    """The bytes that strings of 400 bytes, or of so many whole words, that stand elsewhere leave of each text."""
    raws = [(t or "").encode() for t in texts]

    def strings(r):
        at = [m.span() for m in WORD.finditer(r)]
        return [(a, at[i + words - 1][1]) for i, (a, _) in enumerate(at[: max(0, len(at) - words + 1)])]

    long, whole = Counter(r[i : i + 400] for r in raws for i in range(len(r) - 399)), Counter(r[a:b] for r in raws for a, b in strings(r))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for a, b in [(i, i + 400) for i in range(len(r) - 399) if long[r[i : i + 400]] > 1] + [x for x in strings(r) if whole[r[x[0] : x[1]]] > 1]:
            gone[a:b] = b"\1" * (b - a)
        out.append(bytes(b for b, g in zip(r, gone, strict=True) if not g))
    return out


def test_whole_words_against_brute_force(spark):
    rng = random.Random(21)
    texts = corpus(21, 40)
    for n in (50, 51, 52, 56, 60, 75):
        passage = sentence(rng, n)
        texts += [sentence(rng, k) + gap + passage + after + sentence(rng, 30) for k, gap, after in ((20, " ", " "), (47, "\n", "\n\n"), (3, " ", " "))] + [passage]
    tiny = " ".join(rng.choice("abcdefgh") for _ in range(53))
    texts += [f"{sentence(rng, 9)} {tiny} {sentence(rng, 70)}", f"{sentence(rng, 80)} {tiny}", f"{sentence(rng, 30)} x{tiny} end", "a " * 90, "b b " * 60 + sentence(rng, 60)]
    got = {r.doc_id: bytes(r.kept) for r in suffix.without_repeats(frame(spark, texts, False), "doc_id", "text", words=51).collect()}
    for i, want in enumerate(brute_passages(texts, 51)):
        assert got[i] == want, i


def test_stage_cuts_a_passage_of_51_words(spark):
    rng = random.Random(22)
    for n in (51, 55, 60):
        passage = " ".join(rng.choice(WORDS) for _ in range(n))
        assert len(passage.encode()) < 400
        texts = [f"{sentence(rng, 80)} {passage} {sentence(rng, 80)}" for _ in range(4)] + [sentence(rng, 150)]
        docs = frame(spark, texts, False).selectExpr("doc_id", "text", "lang", "rid as source", "cast(length(text) as long) as n_chars")
        got = {r.doc_id: r.text for r in corpus_pipeline.unrepeated_documents(spark, docs, "").collect()}
        assert got[4] == texts[4] and all(got[i] == texts[i].replace(passage, "") for i in range(4))

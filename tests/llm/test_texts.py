"""op 4 to 10 and the shared tools, each against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import bisect
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from kistwerk.llm import classifier, fingerprint, hmm, packing, suffix, textops
from kistwerk.llm.bpe import decode, encode, encoded_documents, read_ranks
from kistwerk.llm.components import connected_components
from kistwerk.llm.minhash import deduplicated, near_duplicates

DOCS = "doc_id long, text string, lang string, rid string, n long"
RANKS, MULTI = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = "the of and ba na ko lu ti re so mi da fe go hu ja po qui wen zo été über año".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "n", "ing", ","]) for _ in range(n))


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(1, 160)) for _ in range(n)]
    passage = sentence(rng, 110)
    for i in range(0, n, 9):
        texts[i] = texts[i] + "\n" + passage + " " + sentence(rng, 5)
    for i in range(1, n, 7):
        words = texts[i - 1].split(" ")
        words[len(words) // 2] = "changed"
        texts[i] = " ".join(words)
    texts[5] = texts[4]
    texts[6] = texts[4].upper()
    texts += [None, "", " \t\n", "one", "one two", "ONE TWO", "x" * 3000, "y" * 500 + "z", "ab" * 600, "long " * 20000, "\x00null\x00 byte", "emoji 👩‍👩‍👧 ñ    wide"]
    return texts


def frame(spark, texts, repeat=True):
    rows = [(i, t, "en", "clash", 7) for i, t in enumerate(texts)] + ([(3, texts[3], "en", "clash", 7)] if repeat else [])
    return spark.createDataFrame(rows, DOCS).repartition(3)


def words(t):
    return (t or "").encode().lower().split()


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def roots(n, links):
    up = list(range(n))
    for a, b in links:
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)
    out = []
    for i in range(n):
        while up[i] != i:
            i = up[i]
        out.append(i)
    return out


def test_word_hashes_follow_words():
    texts = [(t or "").encode() for t in corpus()]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    h, at = textops.word_hashes(data, off)
    names: dict = {}
    for k, t in enumerate(texts):
        w = t.lower().split()
        mine = h[at[k] : at[k + 1]].tolist()
        assert len(mine) == len(w)
        for a, b in zip(w, mine, strict=True):
            assert names.setdefault(a, b) == b
    assert len(set(names.values())) == len(names)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long").repartition(4)).collect()}
    want = roots(500, links)
    assert got == {i: want[i] for a, b in links if a != b for i in (a, b)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark):
    texts = corpus()
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = roots(len(texts), links)
    got = near_duplicates(frame(spark, texts), "doc_id", "text").collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id), r
    kept = deduplicated(frame(spark, texts), "doc_id", "text", 85)
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert near_duplicates(frame(spark, texts).limit(0), "doc_id", "text").count() == 0


def test_near_duplicates_by_chain(spark):
    """Neighbours are alike, the ends are not: no centre alone finds all links."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([f"c{j}" if j < 4 * k else w for j, w in enumerate(base)]) for k in range(25)]
    got = near_duplicates(frame(spark, texts, False), "doc_id", "text").collect()
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(25) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert links and {r.doc_id: r.component_id for r in got} == dict(enumerate(roots(25, links)))


def test_null_ids(spark):
    t = sentence(random.Random(3), 40)
    got = near_duplicates(spark.createDataFrame([(None, t), (9, t), (None, None)], "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(None, 9, False), (9, 9, True), (None, None, True)], key=str)


def brute_cut(texts):
    raws = [(t or "").encode() for t in texts]
    starts = Counter(r[i : i + 400] for r in raws for i in range(len(r) - 399))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - 399):
            if starts[r[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_suffix(spark, seed):
    rng = random.Random(seed)
    texts = corpus(seed)
    shared = sentence(rng, 300)
    texts += [shared[a : a + n] + sentence(rng, 60) for a, n in ((0, 400), (0, 399), (100, 900), (501, 450), (502, 450))]
    texts += ["q" * 401 + sentence(rng, 30), "r" * 1000, shared * 2, "na " * 700, "x" + "na " * 140, "ab" * 199 + "c", "r" * 400 + "s"]
    got = {r.doc_id: r for r in suffix.cut_documents(frame(spark, texts, False)).collect()}
    for i, want in enumerate(brute_cut(texts)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, i
    assert suffix.cut_documents(frame(spark, texts).limit(0)).count() == 0


def test_suffix_repeated_row(spark):
    t = sentence(random.Random(5), 200)
    got = suffix.cut_documents(spark.createDataFrame([(1, t), (1, t), (2, "short")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, len(t.encode())), (1, len(t.encode())), (2, 0)]


def test_bpe(spark):
    import base64

    import tiktoken

    texts = corpus() + ["don't  stop\n\n  now!!  ", "ＡＢ①½  x y", "<|endoftext|>"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = encoded_documents(frame(spark, texts), MULTI, public_tokenizers.PATTERN).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    raw = read_ranks(MULTI)
    ids = encode(frame(spark, texts), "doc_id", "text", raw, public_tokenizers.PATTERN)
    assert all(bytes(r.bytes).decode() == (texts[r.doc_id] or "") for r in decode(ids, "doc_id", "ids", raw).collect())
    assert encode(frame(spark, texts).limit(0), "doc_id", "text", raw, public_tokenizers.PATTERN).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = corpus()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.packed_documents(frame(spark, texts, False), RANKS, public_tokenizers.PATTERN).collect()
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // 1024))) and sum(r.length for r in mine) == len(ids)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and (r.length == 1024 or r.piece == 0)
    for s in {r.sequence_id for r in got}:
        mine = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        assert [o for o, _ in mine] == [sum(x for _, x in mine[:k]) for k in range(len(mine))] and sum(x for _, x in mine) <= 1024
    assert packing.packed_documents(frame(spark, texts).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_sum_of_squares_rule():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 21, 400)
    where, at = packing.sum_of_squares(lengths, 20)
    gaps: list[int] = []
    for k, n in enumerate(lengths.tolist()):
        def cost(g, b):
            left = sorted(gaps[:b] + gaps[b + 1 :] + [g - n] if b < len(gaps) else [*gaps, g - n])
            return sum(c * c for x, c in Counter(left).items() if x)

        best = min(cost(gaps[b] if b < len(gaps) else 20, b) for b in range(len(gaps) + 1) if b == len(gaps) or gaps[b] >= n)
        b = int(where[k])
        assert cost(gaps[b] if b < len(gaps) else 20, b) == best
        assert at[k] == 20 - (gaps[b] if b < len(gaps) else 20)
        if b == len(gaps):
            gaps.append(20)
        gaps[b] -= n


def test_packing_is_close_to_the_bound(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 1025, 3000))]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES), 1024, rows_per_group=500).collect()
    gaps: list[int] = []  # best fit by falling length, all in one group
    for n in sorted((r[3] for r in rows), reverse=True):
        k = bisect.bisect_left(gaps, n)
        bisect.insort(gaps, (gaps.pop(k) if k < len(gaps) else 1024) - n)
    assert len({r.sequence_id for r in got}) <= 1.03 * len(gaps)  # groups far smaller than in use


def brute_forward(model, classes):
    a = model.start * model.emit[:, classes[0]]
    for c in classes[1:]:
        a = (a @ model.step) * model.emit[:, c]
    return math.log10(a.sum())


def test_forward_is_exact_and_training_helps():
    rng = np.random.default_rng(0)
    model = hmm.Model(np.append(rng.random(hmm.CLASSES), 1.0), 1e-3, states=3)
    sizes = np.array([1, 7, 30, 2])
    classes = rng.integers(0, 50, sizes.sum())
    got = hmm.log10_likelihood(model, classes, sizes)
    at = np.cumsum(sizes) - sizes
    assert np.allclose(got, [brute_forward(model, classes[a : a + n]) for a, n in zip(at, sizes, strict=True)])
    stream = np.concatenate([rng.integers(0, 20, 64) if k % 2 else rng.integers(20, 40, 64) for k in range(60)])
    first = np.arange(len(stream)) % 64 == 0
    before = hmm.log10_likelihood(model, stream, np.full(60, 64)).sum()
    for _ in range(6):
        model.update(*hmm.expected_counts(model, stream, first))
    assert hmm.log10_likelihood(model, stream, np.full(60, 64)).sum() > before + 500
    assert np.allclose(model.emit.sum(1), 1)


def enumerated_counts(model, texts):
    """Baum-Welch counts by going through all state paths."""
    n = len(model.start)
    starts, steps, emits = np.zeros(n), np.zeros((n, n)), np.zeros((n, hmm.CLASSES + 2))
    for text in texts:
        weight = {}
        for path in itertools.product(range(n), repeat=len(text)):
            p = model.start[path[0]] * math.prod(model.emit[s, c] for s, c in zip(path, text, strict=True))
            weight[path] = p * math.prod(model.step[a, b] for a, b in itertools.pairwise(path))
        total = sum(weight.values())
        for path, p in weight.items():
            starts[path[0]] += p / total
            for a, b in itertools.pairwise(path):
                steps[a, b] += p / total
            for s, c in zip(path, text, strict=True):
                emits[s, c] += p / total
    return starts, steps, emits


@pytest.mark.parametrize(("long", "together"), [(100, 1000), (3, 1000), (3, 4), (2, 1), (1, 5)])
def test_expected_counts_are_those_of_all_paths(long, together):
    """Also where texts are cut into spans: nothing is lost at their edges."""
    rng = np.random.default_rng(1)
    model = hmm.Model(rng.random(hmm.CLASSES + 1), 1e-3, states=3)
    texts = [rng.integers(0, hmm.CLASSES + 2, n) for n in (1, 5, 7, 2, 8, 3, 8)]
    first = np.concatenate([np.arange(len(x)) == 0 for x in texts])
    got = hmm.expected_counts(model, np.concatenate(texts), first, long, together)
    for a, b in zip(got, enumerated_counts(model, texts), strict=True):
        assert np.allclose(a, b, atol=1e-5)


def test_hmm_documents(spark):
    texts = corpus(4, 120)
    docs = frame(spark, texts)
    got = hmm.scored_documents(docs).collect()
    everyone = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    learn = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    c = Counter(w for i, t in everyone if learn(i) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(everyone)
    for r in got:
        w = [*words(texts[r.doc_id]), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learn(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert hmm.scored_documents(docs.limit(0)).count() == 0


def test_probabilities_of_all_words_sum_to_one(spark):
    """One-word texts: the model spends one unit on all known words, the unknown one and the end."""
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(random.Random(i).choices(vocabulary, k=30)), True) for i in range(30)] + [(100 + k, w, False) for k, w in enumerate([*vocabulary, "never"])] + [(999, "", False)]
    got = {r.doc_id: r.score for r in hmm.score(spark.createDataFrame(rows, "doc_id long, text string, learn boolean"), "doc_id", "learn", "text").collect()}
    known = {w for _, t, f in rows if f for w in t.split()}
    total = sum(10 ** got[100 + k] for k, w in enumerate([*vocabulary, "never"]) if w in known or w == "never")
    assert 10 ** got[999] < 1 and total < 1  # each also pays for its end


def test_fingerprints(spark):
    texts = corpus(7)
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(frame(spark, texts, False)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        a, b = t or "", texts[(i + 1) % len(texts)] or ""
        k = len(a) // 4
        edited = a[: len(a) - k] + b[:k]
        points = lambda s: fingerprint.code_points(np.frombuffer(s.encode(), np.uint8))
        x, y, z = (fingerprint.sketch(points(s)) for s in (a, edited, b))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(edited.encode()).hexdigest()), i
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.text_of(x), fingerprint.text_of(y))
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(x, y), fingerprint.likeness(x, z))
    assert got[4].fingerprint == got[5].fingerprint
    assert fingerprint.edited_fingerprints(frame(spark, texts).limit(0)).count() == 0
    alone = fingerprint.edited_fingerprints(spark.createDataFrame([(None, "abcd" * 9)], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_order_matters_in_fingerprints():
    rng = random.Random(2)
    a, b = sentence(rng, 200), sentence(rng, 200)
    points = lambda s: fingerprint.sketch(fingerprint.code_points(np.frombuffer(s.encode(), np.uint8)))
    moved, swapped = a[:-40] + b[:40], a[len(a) // 2 :] + a[: len(a) // 2]
    assert fingerprint.likeness(points(a), points(moved)) > fingerprint.likeness(points(a), points(swapped))


def test_occurrence_numbers():
    h = np.array([5, 7, 5, 5, 9], np.uint64)
    x = fingerprint.numbered(h)
    assert len(set(x.tolist())) == 5 and x[0] == fingerprint.numbered(np.array([5], np.uint64))[0]


def test_classifier(spark):
    rng = random.Random(9)
    good = [sentence(rng, rng.randint(20, 120)) for _ in range(300)]
    bad = [" ".join(w.upper() + "!!" for w in sentence(rng, rng.randint(20, 120)).split()) for _ in range(100)]
    texts = good + bad + [None, "", "x" * 5000]
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(400)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, texts, False)
    got = {r.doc_id: r for r in classifier.judged_documents(docs, labels).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [i for i in range(400) if got[i].held_out]
    assert np.mean([got[i].predicted == int(i < 300) for i in held]) > 0.95
    kept = classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].predicted}
    none = classifier.judged_documents(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert classifier.judged_documents(docs.limit(0), labels).count() == 0


def test_chunks_cover_everything():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        data = np.arange(n, dtype=np.uint8)
        x, count = classifier.chunks(data, np.array([0, n]))
        assert count.tolist() == [len(classifier.chunk_starts(n))] and (x != classifier.PAD).sum() >= n
        seen = {s + k for s in classifier.chunk_starts(n).tolist() for k in range(classifier.CHUNK)}
        assert seen >= set(range(n))


def plain_forward(net, texts, labels):
    """The network by loops over bytes: score of each text, and the mean loss."""
    scores = []
    for t in texts:
        raw, per_chunk = t.encode(), []
        for start in classifier.chunk_starts(len(raw)).tolist():
            chunk = list(raw[start : start + classifier.CHUNK])
            chunk += [classifier.PAD] * (classifier.CHUNK - len(chunk))
            best = np.full(classifier.FILTERS, -np.inf)
            for place in range(0, classifier.CHUNK - classifier.WIDTH + 1, classifier.STRIDE):
                window = np.concatenate([net.embed[b].astype(float) for b in chunk[place : place + classifier.WIDTH]])
                best = np.maximum(best, window @ net.filters.astype(float) + net.bias)
            per_chunk.append(np.maximum(best, 0))
        feats = np.concatenate([np.max(per_chunk, axis=0), np.mean(per_chunk, axis=0)])
        scores.append(1 / (1 + math.exp(-(feats @ net.top + net.shift[0]))))
    return scores, -np.mean([math.log(p if y else 1 - p) for p, y in zip(scores, labels, strict=True)])


def test_network_against_loops_and_numeric_gradients():
    rng = random.Random(3)
    texts, labels = [sentence(rng, n) for n in (3, 60, 170, 400)] + [""], np.array([1, 0, 1, 0, 1], np.float32)
    net = classifier.Network.new(1)
    net.bias[:] = 0.01  # off the kink, on which an empty text's responses would lie
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    x, count = classifier.chunks(np.concatenate(raw), off)
    want, loss = plain_forward(net, texts, labels)
    assert np.allclose(classifier.probability(net, classifier.responses(net, x), count), want, atol=1e-5)
    got, grads = classifier.gradients(net, x, count, labels)
    assert math.isclose(got, loss, rel_tol=1e-4)
    for array, grad in zip(net.arrays(), grads, strict=True):
        flat, step = array.reshape(-1), 1e-3
        for k in np.argsort(-np.abs(np.asarray(grad).reshape(-1)))[:4]:
            kept = flat[k]
            flat[k] = kept + step
            up = plain_forward(net, texts, labels)[1]
            flat[k] = kept - step
            down = plain_forward(net, texts, labels)[1]
            flat[k] = kept
            assert math.isclose((up - down) / (2 * step), np.asarray(grad).reshape(-1)[k], rel_tol=0.02, abs_tol=1e-5)


def test_sample_keeps_texts_whole(spark):
    """Whole texts within the bound on bytes; a longer one is passed over; repeated doc_ids count once."""
    docs = spark.createDataFrame([(i, "x" * (100 * i + 1), 1) for i in range(40)] + [(5, "zz", 1), (5, "zz", 2), (None, "n", 1)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i % 40, i % 2) for i in range(80)] + [(None, 1), (3, None)], "doc_id long, quality int")
    learn = {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2}
    texts, quality = classifier.sample(docs, labels)
    assert len(texts) == len(quality) == len(learn) and sorted(map(len, texts)) == sorted(2 if i == 5 else 100 * i + 1 for i in learn)
    some = classifier.sample(docs, labels, most=3000)[0]
    assert 0 < sum(map(len, some)) <= 3000 and set(some) <= set(texts)
    assert len(classifier.sample(docs, labels, rows=3)[0]) == 3

"""Baum-Welch counts of many texts at a time, against a plain double-precision recursion, and what they cost."""

import numpy as np
import pytest

from kistwerk.llm import hmm


def plain(model, texts):
    """Scaled forward and backward recursion, token by token."""
    n = len(model.start)
    starts, steps, emits = np.zeros(n), np.zeros((n, n)), np.zeros((n, hmm.CLASSES + 2))
    for text in texts:
        e = model.emit[:, text].T
        alpha, beta = np.empty_like(e), np.ones_like(e)
        for t in range(len(text)):
            alpha[t] = (alpha[t - 1] @ model.step if t else model.start) * e[t]
            alpha[t] /= alpha[t].sum()
        for t in range(len(text) - 1, 0, -1):
            beta[t - 1] = model.step @ (e[t] * beta[t])
            beta[t - 1] /= beta[t - 1].sum()
            pair = alpha[t - 1][:, None] * model.step * (e[t] * beta[t])
            steps += pair / pair.sum()
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        starts += gamma[0]
        np.add.at(emits.T, text, gamma)
    return starts, steps, emits


def joined(texts):
    first = np.concatenate([np.arange(len(t)) == 0 for t in texts])
    return np.concatenate(texts), first


@pytest.mark.parametrize(("long", "together"), [(4096, 250_000), (7, 100), (2, 1), (1, 30)])
def test_counts_are_those_of_a_plain_recursion(long, together):
    rng = np.random.default_rng(4)
    model = hmm.Model(np.append(rng.random(hmm.CLASSES), 1.0), 1e-3)
    texts = [rng.integers(0, 40, n) for n in (1, 1, 300, 2, 57, 8, 7, 6, 33, 120)]
    for _ in range(3):  # a trained model is sharper than a new one
        want = plain(model, texts)
        for got, exact in zip(hmm.expected_counts(model, *joined(texts), long, together), want, strict=True):
            assert np.allclose(got, exact, rtol=2e-4, atol=2e-5)
        model.update(*want)


@pytest.mark.parametrize("long", [4096, 5])
def test_unlikely_steps_and_rare_classes_stay_within_single_precision(long):
    """Every token forces a step of probability 1e-11, and its class has probability 1e-11, so that it takes 1e-22 a token."""
    model = hmm.Model(np.append(np.ones(hmm.CLASSES), 1.0), 1e-3, states=2)
    model.step = np.array([[1 - 1e-11, 1e-11], [1e-11, 1 - 1e-11]])
    model.emit = np.full((2, hmm.CLASSES + 2), 1e-35)
    model.emit[0, 0] = model.emit[1, 1] = 1e-11
    texts = [np.arange(n) % 2 for n in (50, 1, 2, 31, 50)]
    for got, exact in zip(hmm.expected_counts(model, *joined(texts), long), plain(model, texts), strict=True):
        assert np.isfinite(got).all() and np.allclose(got, exact, rtol=1e-3, atol=1e-3)


def test_texts_of_like_length_are_handled_together(monkeypatch):
    """Steps of the recursion: a long text among short ones doesn't make its whole group as long."""
    steps = []

    class Counted(hmm.SideBySide):
        def __init__(self, sizes):
            super().__init__(sizes)
            steps.append(len(self.live))

    monkeypatch.setattr(hmm, "SideBySide", Counted)
    rng = np.random.default_rng(5)
    model = hmm.Model(np.append(rng.random(hmm.CLASSES), 1.0), 1e-3, states=3)
    texts = [rng.integers(0, hmm.CLASSES, 10 if i % 100 else 100) for i in range(1000)]
    hmm.expected_counts(model, *joined(texts), together=1100)
    assert sum(steps) < 500  # 1000 when texts came as they lay

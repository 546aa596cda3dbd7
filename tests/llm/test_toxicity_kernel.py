"""The gapped kernel against plain loops, and scoring in arrays against scoring unit by unit."""

import itertools
import random

import numpy as np
import pytest

from treeline.llm import toxicity
from treeline.llm.toxicity import CLASSES, DECAY, SPAN

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def model(seed=1):
    rng = np.random.default_rng(seed)
    return toxicity.Model(rng.normal(size=CLASSES**3).astype(np.float32), 0.3, 1.0, 0.0, 0.5)


def plain_features(unit):
    """All subsequences of three characters within SPAN places, by plain loops over places."""
    row = [CLASSES - 2, *(LETTERS.index(c) for c in unit), CLASSES - 1]
    out = {}
    for a, b, c in itertools.combinations(range(len(row)), 3):
        if c - a < SPAN:
            key = (row[a] * CLASSES + row[b]) * CLASSES + row[c]
            out[key] = out.get(key, 0.0) + DECAY ** (c - a - 2)
    squares = sum(DECAY ** (2 * (c - a - 2)) for a, b, c in itertools.combinations(range(len(row)), 3) if c - a < SPAN)
    return {k: v / max(squares, 1.0) ** 0.5 for k, v in out.items()}


@pytest.mark.parametrize("unit", ["", "a", "ab", "idiot", "aaaaaaa", "abcabcabcabc"])
def test_features_against_plain_loops(unit):
    got = toxicity.features(toxicity.coded([unit]))[0]
    want = np.zeros(CLASSES**3)
    for key, value in plain_features(unit).items():
        want[key] = value
    assert np.allclose(got, want, atol=1e-6)


def test_folded_weights_equal_scoring_by_landmarks():
    rng = random.Random(3)
    texts = ["".join(rng.choice(LETTERS[:6]) for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    labels = np.array([1.0 if "ab" in t else -1.0 for t in texts])
    marks = list(dict.fromkeys(texts))[:30]
    weights, bias = toxicity.fit_machine(texts, labels, marks)
    folded = toxicity.Model(weights.astype(np.float32), bias, 1.0, 0.0).units(texts)
    landmark = toxicity.features(toxicity.coded(marks))
    kernel = toxicity.features(toxicity.coded(texts)) @ landmark.T
    # The folded table is a combination of the landmarks' features, so kernels to them decide alike.
    combination = np.linalg.lstsq(landmark.T.astype(np.float64), weights, rcond=None)[0]
    assert np.allclose(kernel @ combination + bias, folded, atol=1e-3)
    assert (np.sign(folded) == labels).mean() > 0.9


PIECES = ["i", "d", "o", "t", "st", "u", "pid", "idiot", "you", "are", "a", "x1", "é", "№", "...", "-", "word", "longerword", "twelveletter", "привет", "д", "ы", "2", "i,", "(d)", "слово", "你", "ß", "a_b"]


@pytest.mark.parametrize("seed", range(8))
def test_arrays_score_like_single_units(seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    texts += [None, "", " \n ", "...", "a", "i d i o t", "st u pid " * 20, "x" * 200, "a b " * 40]
    one = model(seed)
    own, joined = toxicity.Scorer(one).margins(texts)
    expected_own, expected_joined = one.margins(texts, {})
    assert np.allclose(own, expected_own, atol=1e-9)
    # A joined unit that the text has as its own is left out there, where its own margin counts.
    offset = one.offset
    assert np.allclose(np.maximum(own, joined - offset), np.maximum(expected_own, expected_joined - offset), atol=1e-9)
    assert (joined >= expected_joined - 1e-9).all()


def test_a_scorer_that_forgets_scores_alike(monkeypatch):
    one, texts = model(), ["i d i o t you are", "st u pid word", "longerword a b c d"] * 3
    scorer = toxicity.Scorer(one)
    first = scorer.margins(texts)
    monkeypatch.setattr(toxicity, "CACHE", 2)
    again = scorer.margins(texts)
    assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(first, again))

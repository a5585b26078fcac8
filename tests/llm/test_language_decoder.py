"""The decoder of language codewords against a plain computation."""

import math

import numpy as np
import pyarrow as pa
import pytest

from kpilane.llm import language_id as li
from kpilane.llm.common import utf8_buffer

TEXTS = ["the cat sat on the mat", "", "äöü ß", "la le les un une", "x", "ver schi gen zur " * 20, "中文 abc", "   "]


def _loss(signed):
    return math.log1p(math.exp(-signed)) if signed > -30 else -signed


def _identifier(languages, seed):
    counts = np.random.default_rng(seed).poisson(0.05, (languages, li.FEATURES)).astype(float)
    return li.Identifier([f"l{i}" for i in range(languages)], counts)


@pytest.mark.parametrize("languages", [1, 2, 3, 4, 7, 12, 40])
def test_decode_takes_the_codeword_with_the_least_weighted_loss(languages):
    known = _identifier(languages, languages)
    margins = np.random.default_rng(1).normal(0, 0.3, (50, known.code.shape[1]))
    best, score, ambiguous = known.decode(margins)
    for row in range(50):
        losses = [sum(w * _loss(c * m * s) for c, m, s, w in zip(
            known.code[lang], margins[row], known.scale, known.weights)) for lang in range(languages)]
        least = min(losses)
        assert losses.index(least) == best[row]
        assert math.isclose(score[row], 1 / sum(math.exp(least - x) for x in losses), rel_tol=1e-9)
        gap = sorted(losses)[1] - least if languages > 1 else math.inf
        assert ambiguous[row] == (gap < li.AMBIGUOUS)


@pytest.mark.parametrize("languages", [2, 3, 5, 9, 40])
def test_codewords_differ_and_every_bit_divides(languages):
    code = li.codewords(languages)
    assert len({tuple(r) for r in code}) == languages and set(np.unique(code)) == {-1.0, 1.0}
    assert (np.abs(code.sum(axis=0)) < languages).all()
    distance = min(int((code[a] != code[b]).sum()) for a in range(languages) for b in range(a))
    assert distance >= 1 + (languages > 2)  # one wrong bit is not yet another language


def test_margins_are_means_over_a_texts_own_ngrams():
    known = _identifier(4, 9)
    together = known.margins(*utf8_buffer(pa.array(TEXTS)))
    for i, text in enumerate(TEXTS):
        raw, offsets = utf8_buffer(pa.array([text]))
        total, number = np.zeros(known.odds.shape[1]), 0
        for hashed, whole in li._ngrams(raw, offsets):
            for h, w in zip(hashed.tolist(), whole.tolist()):
                if w:
                    total += known.odds[h].astype(float)
                    number += 1
        assert np.allclose(together[i], total / max(number, 1), atol=1e-6)

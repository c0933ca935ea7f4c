"""Bounds of the fuzzy score against the score itself."""

import random

import pytest

from sceneline.functions import evidence
from sceneline.functions.text import fuzzy, lcs

WORDS = ["a", "de", "la", "rosa", "casa", "ñu", "zz", "der", "haus", "mit", "𝒳y", "的", "ab", "ba", "cab"]


@pytest.mark.parametrize("pile", [1, 200, 1 << 19])
def test_tight_bounds(monkeypatch, pile):
    monkeypatch.setattr(evidence.Stack, "PILE", pile)
    rng = random.Random(4)
    some = lambda n: tuple(rng.choice(WORDS) for _ in range(rng.randint(0, n)))
    blocks = [(i, some(14)) for i in range(200)]
    d = evidence.Dialogue(blocks)
    for line in [(), *(some(10) for _ in range(40))]:
        can = d.tight(line)
        assert all(c >= fuzzy(line, t) - 1e-12 for c, t in zip(can, d.texts, strict=True))
        assert d.stacks[0].common(" ".join(line)).tolist() == [lcs(" ".join(line), t) for t in d.joined]
        score, block = min((-round(fuzzy(line, t), 6), i) for i, t in blocks)
        assert d.best_fuzzy(line) == (-score, block)
    assert evidence.Dialogue([]).best_fuzzy(("a",)) is None


def test_few_comparisons(monkeypatch):
    """Texts of the same letters: the characters that they share leave nearly all of them possible, their order few."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    blocks = [(i, tuple(word() for _ in range(30))) for i in range(300)]
    d, calls = evidence.Dialogue(blocks), []
    monkeypatch.setattr(evidence, "fuzzy", lambda a, b: calls.append(1) or fuzzy(a, b))
    lines = [tuple(word() for _ in range(30)) for _ in range(5)]
    got = [d.best_fuzzy(line) for line in lines]
    assert len(calls) < 5 * 60
    assert got == [(-s, i) for s, i in (min((-round(fuzzy(line, t), 6), i) for i, t in blocks) for line in lines)]

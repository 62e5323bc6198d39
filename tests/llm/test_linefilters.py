"""Both ways of comparing a prefix word's list, shift by shift and in blocks, keep the same rows as all pairs."""

import numpy as np
import pytest

from tideline.llm import linededup


@pytest.mark.parametrize("long", [2, 5, 1000])
def test_with_partner(monkeypatch, long):
    monkeypatch.setattr(linededup, "LONG", long)
    r = np.random.default_rng(long)
    for _ in range(20):
        n = int(r.integers(1, 120))
        word, size = r.integers(0, 4, n), r.choice([4, 5, 50, 60, 63, 64, 70, 90], n)
        order = np.lexsort((size, word))
        word, size = word[order], size[order]
        place = r.integers(0, np.maximum(size // 5, 1))
        sketch = r.integers(0, 1 << 12, n).astype(np.uint64)
        more = np.where(size < linededup.LARGE, 0, r.integers(0, 1 << 12, n)).astype(np.uint64)
        want = np.zeros(n, bool)
        for x in range(n):
            for y in range(x + 1, n):
                if word[x] == word[y] and linededup.possible(size, place, sketch, more, np.array([x]), np.array([y]), 0.8)[0]:
                    want[x] = want[y] = True
        assert (linededup.with_partner(word, size, place, sketch, more, 0.8) == want).all()

"""Words are told apart: numbered words, words that a polynomial hash confuses, long words and odd white space."""

import re

import numpy as np
import pyarrow as pa

from tideline.llm import linededup, substring
from tideline.llm.common import hashed_words


def thue_morse(flip: bool) -> str:
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(1024))


def test_hashes_of_words():
    texts = [" ".join(f"n{i}" for i in range(400_000)), f"{thue_morse(False)} {thue_morse(True)}", None, "", "a\x0bb\x0cc d　e \x1f\r\n", "x" * 64 + " " + "x" * 65 + " " + "x" * 64 + "\0"]
    _, off, start, h = hashed_words(pa.array(texts))
    words = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert len(h) == len(words) and len(np.unique(h)) == len(set(words))
    by = dict(zip(words, h.tolist(), strict=True))
    _, _, _, again = hashed_words(pa.array(words))
    assert again.tolist() == [by[w] for w in words]


def test_unlike_words_are_kept(spark):
    twelve = " ".join(f"w{i}" for i in range(12))
    # Pairs whose 32-bit prefixes of common hashes are equal, and the two words of a polynomial's blind spot.
    pairs = [("n283484", "n379974"), (thue_morse(False), thue_morse(True))]
    rows = [(2 * k + j, f"{twelve} {p[j]}") for k, p in enumerate(pairs) for j in (0, 1)]
    docs = spark.createDataFrame([*rows, (9, f"{twelve} n379974")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.dedup_substrings(docs).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 9: 13}
    lines = spark.createDataFrame([(2 * k + j, p[j]) for k, p in enumerate(pairs) for j in (0, 1)] + [(9, "n379974")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in linededup.dedup_lines(lines).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 9: 1}


def test_hot_minimisers(spark):
    """Pieces of very common minimisers are dealt window by window, with the same result."""
    common = " ".join(f"c{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"x{i} {common} y{i} z") for i in range(600)], "doc_id long, text string")
    shared = substring.shared_minimisers(docs, 600 * 160)
    assert np.bitwise_count(shared[1]).sum() > 0
    got = {r.doc_id: r.n_removed for r in substring.dedup_substrings(docs).collect()}
    assert got == {i: 40 if i else 0 for i in range(600)}


def forged(key: int, size: int) -> tuple[str, str]:
    """Two words of printable characters that collide under a known key: their first parts give states whose difference
    is printable, and their last eight characters differ by it."""
    import random

    from tideline.llm.common import STEP, key_parts, scrambled

    r = random.Random(1)
    more, *factors = key_parts(key)
    with np.errstate(over="ignore"):
        start = scrambled(np.array([size], np.uint64) * STEP + more, *factors)
        heads = ["".join(r.choice("abcdefghijklmnop") for _ in range(size - 8)) for _ in range(60_000)]
        state = np.repeat(start, len(heads))
        for k in range(0, size - 8, 8):
            part = np.array([int.from_bytes(h[k : k + 8].encode(), "little") for h in heads], np.uint64)
            state = scrambled(state ^ part, *factors)
    seen: dict[int, int] = {}
    for i, s in enumerate(state.tolist()):
        if (j := seen.setdefault(s & 0x8080808080808080, i)) != i:
            gap = s ^ int(state[j])
            tail = [next((a for a in range(33, 127) if 33 <= a ^ (gap >> 8 * b & 255) < 127), None) for b in range(8)]
            if None not in tail:
                a = bytes(tail)
                return heads[i] + a.decode(), heads[j] + bytes(x ^ (gap >> 8 * b & 255) for b, x in enumerate(a)).decode()
    raise AssertionError("no pair")


def test_words_that_collide_under_one_key(spark):
    """Pairs found for one key are told apart under others, so a run's own key can't be met."""
    pairs = [("RaQNRwdfWBVqjYUe", "4ImlZ5Ar)|3>5nC~"), *(forged(0, size) for size in (16, 24, 40))]
    for a, b in pairs[1:]:
        assert a != b and len(np.unique(hashed_words(pa.array([a, b]))[3])) == 1
        assert all(len(np.unique(hashed_words(pa.array([a, b]), key)[3])) == 2 for key in (1, 2, 1 << 63, 12345678901234567))
    twelve = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(i, f"{twelve} {w} z{i}") for i, w in enumerate(w for p in pairs for w in p)], "doc_id long, text string")
    assert {r.n_removed for r in substring.dedup_substrings(docs).collect()} == {0}
    lines = spark.createDataFrame([(i, w) for i, w in enumerate(w for p in pairs for w in p)], "doc_id long, text string")
    assert {r.n_removed for r in linededup.dedup_lines(lines).collect()} == {0}

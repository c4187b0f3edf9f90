"""Features of texts: a text's pairs of words are told apart by numbers."""

import numpy as np

from prismlake.llm import quality


def steps(text):
    used, _ = quality.counts(text)
    return [int(k) - (quality.FEATURES - 24) for k in used if k >= quality.FEATURES - 24]


def test_pairs_of_words_are_counted_exactly():
    assert steps(b"a") == [0, 23] and steps(b"a b") == [11, 23]
    assert steps(b"a b a b a b a b a") == [3, 23] and steps(b"ab c a bc") == [11, 23]


def test_cleared_words_change_no_features():
    texts = [b"Some words, and more WORDS!! and 12 words", "é ü words".encode(), b"words words"]
    before = [quality.counts(t) for t in texts]
    quality._ids.clear()
    quality._ids.update({str(k).encode(): k << 32 for k in range(300_001)})
    after = [quality.counts(t) for t in reversed(texts)][::-1]
    assert len(quality._ids) < 100
    assert all(np.array_equal(a, b) for x, y in zip(before, after, strict=True) for a, b in zip(x, y, strict=True))

"""The quality model sees word order and whole characters beyond ASCII."""

import random

import numpy as np

from lumenlake.llm import quality


def test_word_order_is_seen():
    rng, words = random.Random(4), [f"word{i}" for i in range(12)]
    rows = []
    for k in range(400):
        order = rng.sample(range(6), 6)  # the same words in both classes: pairs in order, or turned round
        pairs = [w for i in order for w in (words[2 * i], words[2 * i + 1])[:: 1 if k % 2 else -1]]
        rows.append(("\n\n\n".join(["start", *pairs, "end"]), k % 2))
    model = quality.fit(rows[:300])
    right = [(quality.score(model, t, t.encode().split()) >= 0.5) == bool(y) for t, y in rows[300:]]
    assert sum(right) >= 95


def test_characters_are_whole_and_scores_agree_with_features():
    text = "漢字仮名"
    ids, _ = quality.features(text)
    chars = ids[(ids >= 1 << quality.WORD_BITS) & (ids < (1 << quality.WORD_BITS) + (1 << quality.CHAR_BITS))]
    assert len(chars) == 2  # two windows of three characters, not ten of bytes
    model = {"w": np.random.default_rng(1).normal(size=quality.SIZE).astype(np.float32), "bias": 0.1, "scale": (0.3, 0.2)}
    for t in ("", "a", "ab", "one", "one two three one two", text, "é \U0001f600 x"):
        ids, v = quality.features(t)
        want = 1 / (1 + np.exp(-(0.3 * (model["w"][ids] @ v + 0.1) + 0.2)))
        assert abs(quality.score(model, t, t.encode().split()) - want) < 1e-6

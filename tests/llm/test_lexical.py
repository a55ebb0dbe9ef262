"""op12 against plain scoring of all documents, with bounds and edges."""

import math
import random
import re

import numpy as np

from lumenlake.llm import lexical

TERM = re.compile(lexical.TERM)


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    held = [(key, terms(t)) for key, t in docs]
    held = [(key, ts) for key, ts in held if ts]
    n, words = len(held), sum(len(ts) for _, ts in held)
    df = {}
    for _, ts in held:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    wanted = {}
    for key, t in items:
        wanted.setdefault(key, set()).update(terms(t))
    out = []
    for key, ts in wanted.items():
        scored = []
        for doc, has in held:
            m = 50 + (50 * len(has) * n) // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m)) for t in ts if (tf := has.count(t)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(key, r, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=50):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, rank int, item_id string")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, score int")
    return sorted((tuple(r) for r in lexical.search(d, i, k).collect()), key=str)


def corpus(n, seed, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)] + ["Été", "ÉTÉ", "日本", "A1b"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 40)))) for k in range(n)]


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 16)
    docs, items = corpus(300, 1), corpus(12, 2)
    assert found(spark, docs, items, 7) == brute(docs, items, 7)
    assert found(spark, docs, items) == brute(docs, items)


def test_passes(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TERMS_A_PASS", 20)
    docs, items = corpus(60, 3), corpus(9, 4)
    assert found(spark, docs, items, 5) == brute(docs, items, 5)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " ,.;\n"), (4, "One one ONE\0two"), (4, "One one ONE\0two"), (None, "two three"), (5, "three " * 50_000), (6, "été Été"), (7, "unseen"), (None, None)]
    docs += [(100 + k, "same words here") for k in range(120)]  # more equal scores than places
    items = [(1, "one TWO"), (2, None), (3, ""), (4, "three été"), (None, "words"), (None, "here"), (5, "absent"), (6, "same"), (6, "same"), (7, "x " * 30_000 + " ".join(f"t{k}" for k in range(3000)) + " two")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, [], items) == [] == found(spark, docs, [])


def test_bounds_are_never_passed():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n, size = rng.integers(1, 7), 12
        impact = rng.integers(0, 50, size=(n, size)) * (rng.random((n, size)) < 0.5)
        both = np.array([max([int(a[d] + b[d]) for d in range(size) if a[d] and b[d]], default=0) for a, b in zip(impact, impact[1:], strict=False)], dtype=np.int64)
        bound = lexical.bounds(impact.max(axis=1), both)
        for j in range(n + 1):
            assert bound[j] >= impact[:j].sum(axis=0).max(initial=0)
            assert bound[j] <= impact[:j].max(axis=1, initial=0).sum()


def test_pairs_tighten():
    assert lexical.bounds(np.array([5, 7, 4]), np.array([0, 0])).tolist() == [0, 5, 7, 11]
    assert lexical.bounds(np.array([5, 7, 4]), np.array([9, 10])).tolist() == [0, 5, 9, 13]

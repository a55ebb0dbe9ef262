"""Close pairs against all pairs."""

import numpy as np
import pytest

from lumenlake.operators.vector_index import RINGS, Cells, Tree, close_pairs, dealt, meetings


def rows_of(kind: str) -> list[tuple]:
    rng = np.random.default_rng(5)
    if kind == "empty":
        return []
    middles = rng.normal(size=(12, 16))
    v = middles[rng.integers(0, 12, 300)] + rng.normal(scale=0.35, size=(300, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "hot":
        v[::3] = v[0]
    if kind == "lengths":
        v *= rng.uniform(0, 1.5, (300, 1))
        v[7] = 0
    return [(f"k{i:03d}", [float(x) for x in np.float32(r)], i % 40) for i, r in enumerate(v)]


@pytest.mark.parametrize("kind, t", [("clusters", 0.82), ("hot", 0.82), ("lengths", 0.6), ("lengths", -0.2), ("empty", 0.8)])
def test_no_pair_is_lost(spark, kind, t):
    made = rows_of(kind)
    df = spark.createDataFrame(made, "id string, vector array<float>, g int").repartition(3)
    got = {(r["a"], r["b"]) for r in close_pairs(df, t, group="g", rows_a_block=16).collect()}
    want = {(a[0], b[0]) for k, a in enumerate(made) for b in made[k + 1 :] if a[2] != b[2] and np.dot(np.float64(a[1]), np.float64(b[1])) >= t}
    assert got == want


def test_blocks_hold_no_more_than_their_share():
    rng = np.random.default_rng(1)
    tree = Tree.of(rng.normal(size=(40, 6)))
    known = Cells.of([{"cell": c, "n": int(n), "low": 0.1, "high": 1.0, "longest": 1.0} for c, n in enumerate(rng.integers(0, 12, 40 * RINGS))], 40)
    known.n[7] = 1000
    start, parts, n = dealt(tree, known, 100)
    held = np.zeros(n)
    for cell in range(40 * RINGS):
        held[start[cell] : start[cell] + parts[cell]] += known.n[cell] / parts[cell]
    assert held.max() <= 100 and parts[7] == 10 and n < 60


def test_angles_leave_blocks_out_where_vectors_cluster(spark):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(30, 32))
    v = middles[rng.integers(0, 30, 3000)] + rng.normal(scale=0.2, size=(3000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(np.float32(v))], "id long, vector array<float>")
    near, rows = meetings(df, 0.9, rows_a_block=128)
    wide, _ = meetings(df, 0.0, rows_a_block=128)
    assert rows.count() == 3000
    assert near.count() < 0.5 * wide.count()
    assert close_pairs(df, 0.9, rows_a_block=128).count() == int(np.triu(np.float64(np.float32(v)) @ np.float64(np.float32(v)).T >= 0.9, 1).sum())

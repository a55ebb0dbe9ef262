"""op11 against a plain search over all rows, with the bounds and the edges of its input."""

import math

import numpy as np
import pytest

from lumenlake.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, anchor_id string, score string"


def brute(rows):
    """The contract row by row; rows: (vec_id, vector, label)."""
    held = []
    for k, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if k is not None and k % 7 == 0:
            label = (label + 1) % 10
        held.append((k, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for i, (k, q, label) in enumerate(held):
        if k is None or k % 50:
            continue
        scored = [(-max(min(sum(a * b for a, b in zip(q, p, strict=True)), negatives.HIGHEST), negatives.LOWEST), n is None, n or 0, m) for j, (n, p, m) in enumerate(held) if j != i and len(p) == len(q)]
        scored.sort(key=lambda s: s[:3])
        for s in [s for s in scored if s[3] == label][:5]:
            hard = [h for h in scored if h[3] != label and 50 * -s[0] <= 100 * -h[0] <= 95 * -s[0]][:3]
            out += [(k, None if s[1] else s[2], r, None if h[1] else h[2], -s[0], -h[0]) for r, h in enumerate(hard, 1)]
    return sorted(out, key=str)


def mined(spark, rows, **named):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in negatives.mine(df, **named).collect()), key=str)


def vectors(n, dim, seed, clusters=6, wide=0.25):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(clusters, dim))
    made = middles[rng.integers(clusters, size=n)] + rng.normal(size=(n, dim)) * wide
    made = made / np.linalg.norm(made, axis=1, keepdims=True) * rng.uniform(0.2, 3, size=(n, 1))
    return [(k, [float(x) for x in v], int(rng.integers(4))) for k, v in enumerate(made.astype(np.float32))]


def test_clusters_and_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SMALL", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rows = vectors(400, 12, 1)
    assert len(brute(rows)) > 50
    assert mined(spark, rows) == brute(rows)


def test_edges(spark):
    rows = vectors(120, 5, 2)
    rows += [(50, rows[50][1], rows[50][2]), (50, rows[50][1], rows[50][2])]  # repeated anchors
    rows += [(None, rows[3][1], 1), (None, None, 1), (200, None, 2), (201, [1.0] * 5, None), (202, [1.0, None, 0.0, 0.0, 0.0], 2)]
    rows += [(203, [math.inf, 0.0, 0.0, 0.0, 0.0], 1), (204, [math.nan, 0.0, 0.0, 0.0, 0.0], 1), (250, [0.0] * 5, 1), (251, [0.0] * 5, 1), (252, [0.0] * 5, 2)]
    rows += [(300, [1.0, 0.5], 1), (301, [1.0, 0.5], 1), (302, [0.9, 0.3], 2), (350, [], 1), (351, [], 1), (352, [], 2)]
    rows += [(400 + k, rows[0][1], k % 3) for k in range(40)]  # one vector many times
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []


def test_huge_components(spark):
    rows = [(50 * k, [3e12 * (k + 1), 1.0], k % 2) for k in range(4)] + [(1, [3e38, 3e38], 0), (2, [2e12, 5.0], 1)]
    assert mined(spark, rows) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(8, 16))
    middles /= np.linalg.norm(middles, axis=1, keepdims=True)
    q = np.floor(256 * rng.normal(size=(300, 16)))
    q[::7] = q[0]
    norm = np.linalg.norm(q, axis=1)
    angles = np.arccos(np.clip(q @ middles.T / norm[:, None], -1, 1)).astype(np.float32)
    for a in range(40):
        low, high = negatives.score_bounds(norm[a], angles[a], norm, angles)
        exact = q @ q[a]
        assert (low <= exact).all() and (exact <= high).all()
        assert (high - low).mean() < 1.9 * (norm * norm[a]).mean()


def test_bounds_leave_rows_out(monkeypatch, spark):
    scored = []
    plain = negatives.products
    monkeypatch.setattr(negatives, "products", lambda a, rows: scored.append(len(rows)) or plain(a, rows))
    import pyarrow as pa

    rows = vectors(600, 8, 4, clusters=12, wide=0.05)
    q = np.array([np.floor(256 * np.array(v)) for _, v, _ in rows])
    middles = q[:12] / np.linalg.norm(q[:12], axis=1, keepdims=True)
    norm = np.linalg.norm(q, axis=1)
    angles = np.arccos(np.clip(q @ middles.T / norm[:, None], -1, 1)).astype(np.float32)
    table = pa.table({"row": np.arange(600), "vec_id": np.arange(600), "label": np.zeros(600, dtype=np.int64), "q": list(q), "norm": norm, "angles": list(angles)})
    asked = table.slice(0, 20).append_column("windows", pa.array([[{"window": 0, "low": negatives.LOWEST, "high": negatives.HIGHEST}]] * 20))
    found = negatives.meet(asked, table, True, 5).to_pylist()
    assert sum(scored) < 0.5 * 20 * 600
    for a in range(20):
        exact = q @ q[a]
        wanted = sorted((int(-s), k) for k, s in enumerate(exact) if k != a)[:5]
        assert [(-f["score"], f["vec_id"]) for f in found if f["anchor"] == a] == wanted


@pytest.mark.parametrize("x", [0.0, -0.1, 0.1, 1.0, -1.0, 255.99, 1e-30, -1e-30, 3e38, -3e38])
def test_floor(spark, x):
    made = spark.createDataFrame([([x],)], "v array<float>").select(negatives.integers(negatives.F.col("v"))).first()[0][0]
    assert made == math.floor(256 * float(np.float32(x)))

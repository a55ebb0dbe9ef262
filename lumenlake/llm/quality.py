"""Quality rules: counted base rules and a logistic regression over hashed word and character n-grams."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.names import fresh, quoted
from lumenlake.llm.samples import labelled_sample

WORD_BITS, CHAR_BITS, PAIR_BITS = 15, 16, 16
SIZE = (1 << WORD_BITS) + (1 << CHAR_BITS) + (1 << PAIR_BITS)
#: Characters that count as symbols (fixed values of the base rules).
SYMBOLS = "#*$%&|<>"
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x and x.strip(" \t\n\v\f\r")]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    if len(seen) == n:
        return 0
    _, two = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)  # pairs first: no product overflows
    _, three, count = np.unique(two[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[three] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def char_slots(points: np.ndarray) -> np.ndarray:
    """Slots of the character 3-grams that start at each code point (the last two are not windows)."""
    h = points[:-2] * np.uint32(0x9E3779B1) ^ points[1:-1] * np.uint32(0x85EBCA77) ^ points[2:] * np.uint32(0xC2B2AE3D)
    return (h >> np.uint32(32 - CHAR_BITS)) + np.uint32(1 << WORD_BITS)


def word_slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the single words, and of the pairs of neighbours in their order."""
    h = np.fromiter(map(crc32, words), np.uint32, len(words))
    pairs = (h[:-1] * np.uint32(0x9E3779B1) ^ h[1:] * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D)
    return h & np.uint32((1 << WORD_BITS) - 1), (pairs >> np.uint32(32 - PAIR_BITS)) + np.uint32((1 << WORD_BITS) + (1 << CHAR_BITS))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and mean frequencies of word 1-grams and 2-grams and of character 3-grams."""
    points = code_points(text)
    out = []
    for slots in (*word_slots(text.encode("utf-8", "surrogatepass").split()), char_slots(points) if len(points) > 2 else np.empty(0, np.uint32)):
        ids, n = np.unique(slots, return_counts=True)
        out.append((ids, n / max(1, len(slots))))
    return np.concatenate([o[0] for o in out]).astype(np.int64), np.concatenate([o[1] for o in out])


def fit(rows: list[tuple[str, int]], epochs: int = 30, rate: float = 0.5, l2: float = 1e-6) -> dict | None:
    """Weights and a Platt scale; None unless both classes are there. Every fifth row is held out for the scale."""
    if len({y for _, y in rows}) < 2:
        return None
    x, y = [features(t) for t, _ in rows], np.array([q for _, q in rows], dtype=float)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    w, total, bias, bias_total = np.zeros(SIZE), np.full(SIZE, 1e-6), 0.0, 1e-6
    share = np.clip(y[~held].mean(), 0.02, 0.98)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    rng, order = np.random.default_rng(7), np.flatnonzero(~held)
    for _ in range(epochs):
        rng.shuffle(order)
        for k in order:
            ids, v = x[k]
            g = weight[k] * (1 / (1 + np.exp(-np.clip(w[ids] @ v + bias, -30, 30))) - y[k])
            step = g * v + l2 * w[ids]
            total[ids] += step * step
            w[ids] -= rate * step / np.sqrt(total[ids])
            bias_total += g * g
            bias -= rate * g / np.sqrt(bias_total)
    scale = platt(np.array([w[i] @ v + bias for i, v in x])[held if held.any() else ~held], y[held if held.any() else ~held])
    return {"w": w.astype(np.float32), "bias": bias, "scale": scale}


def platt(s: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift of a logistic calibration with smoothed targets, by Newton steps."""
    up, down = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    z = np.stack([s, np.ones_like(s)], 1)
    c = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        move = np.linalg.solve(h, z.T @ (p - target))
        c -= np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-8:
            break
    return (float(c[0]), float(c[1])) if c[0] > 0 else (1.0, 0.0)


def score(model: dict | None, text: str, words: list[bytes]) -> float:
    """Calibrated probability of good quality; 1 without a model, so that nothing is thrown away unlearnt."""
    if model is None:
        return 1.0
    w, s = model["w"], model["bias"]
    for slots in word_slots(words):
        if len(slots):
            s += float(w[slots].mean(dtype=np.float64))
    if len(text) > 2:
        points, total = code_points(text), 0.0
        for at in range(0, len(points) - 2, 1 << 20):
            total += float(w[char_slots(points[at : at + (1 << 20) + 2])].sum(dtype=np.float64))
        s += total / (len(points) - 2)
    a, b = model["scale"]
    return float(1 / (1 + np.exp(-np.clip(a * s + b, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, bound: int = 4000) -> dict | None:
    """Fit on at most `bound` labelled rows (label `quality`, 1 is good)."""
    return fit([(r["text"], r["label"]) for r in labelled_sample(docs, labels, "quality", bound)])


def judge(docs: DataFrame, model: dict | None, threshold: float = 0.5, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """All columns of docs, then the base counts, base_failed, quality_score and kept.

    base_failed: fewer than min_words words, or more than max_repeat percent of them in repeated 3-word
    windows. kept: not base_failed and a score of at least `threshold`. A null text is an empty one
    (no words, so it fails); repeated rows are judged alike. Columns of docs with a result's name are
    replaced. Map-only: one Arrow pass over the whole texts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    made = [*COLUMNS, "base_failed", "quality_score", "kept"]
    docs = docs.drop(*made)
    (own,) = fresh(docs, "judged")
    kind = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality_score double, kept boolean"

    def run(parts: pd.Series) -> pd.DataFrame:
        out = []
        for t in parts:
            t = t or ""
            words = t.encode("utf-8", "surrogatepass").split()
            n = base_counts(t, words)
            failed = n[0] < min_words or 100 * n[4] > max_repeat * n[0]
            p = score(sent.value, t, words)
            out.append((*n, failed, p, bool(not failed and p >= threshold)))
        return pd.DataFrame(out, columns=made)

    return docs.withColumn(own, F.pandas_udf(run, kind)(F.col("text").cast("string"))).select(*[F.col(quoted(c)) for c in docs.columns], f"{own}.*")

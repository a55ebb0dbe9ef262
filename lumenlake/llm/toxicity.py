"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.quality import platt
from lumenlake.llm.samples import labelled_sample

BITS = 16
PAD = 1 << BITS
WIDTHS = (1, 2, 3)
#: Bytes of each word that a hash sees: the whole word and two of its beginnings, which inflected forms share.
PARTS = (1 << 30, 6, 4)
#: Bytes that make up words in a lower-cased UTF-8 text: a-z and every part of a longer character.
LETTER = np.array([97 <= k <= 122 or k >= 128 for k in range(256)])
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.full(4096, 0x9E3779B1, dtype=np.uint32), dtype=np.uint32)


def codes(texts: list[str | None], chunk: int = 1 << 20) -> list[np.ndarray]:
    """For each whole text the (words, parts) embedding rows; texts are hashed together, about `chunk` bytes at a time."""
    out, group, size = [], [], 0
    for t in texts:
        data = (t or "").lower().encode("utf-8", "surrogatepass") + b"\n"
        group.append(data)
        size += len(data)
        if size >= chunk:
            out += _hashed(group)
            group, size = [], 0
    return out + (_hashed(group) if group else [])


def _hashed(group: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b"".join(group), dtype=np.uint8)
    inside = LETTER[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False))  # every text ends with a line feed, so edges come in pairs
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return [np.empty((0, len(PARTS)), dtype=np.int64) for _ in group]
    sizes = ends - starts
    at = np.flatnonzero(inside)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(at)) - np.repeat(first, sizes)
    terms = data[at].astype(np.uint32) * POWERS[place & 4095]
    made = np.empty((len(starts), len(PARTS)), dtype=np.int64)
    for k, n in enumerate(PARTS):
        h = np.add.reduceat(np.where(place < n, terms, np.uint32(0)), first)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        made[:, k] = (h ^ (h >> np.uint32(13))) & np.uint32(PAD - 1)
    bounds = np.searchsorted(starts, np.cumsum([len(g) for g in group]))
    return np.split(made, bounds[:-1])


class ConvNet:
    """Hashed embeddings of word parts, filters of several widths, ReLU, max pooling, a logistic layer."""

    def __init__(self, dim: int = 6, filters: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.dim, self.filters = dim, filters
        self.tables = rng.normal(0, 0.1, (len(PARTS), PAD + 1, dim)).astype(np.float32)
        self.tables[:, PAD] = 0
        self.w = [rng.normal(0, 0.3, (k, len(PARTS) * dim, filters)).astype(np.float32) for k in WIDTHS]
        self.b = np.zeros((len(WIDTHS), filters), np.float32)
        self.out, self.bias = rng.normal(0, 0.3, (len(WIDTHS), filters)).astype(np.float32), np.float32(0)
        self.scale, self.thresholds = (1.0, 0.0), {}

    def embed(self, c: np.ndarray) -> np.ndarray:
        """The parts' rows side by side; row PAD is padding."""
        return np.concatenate([t[c[:, k]] for k, t in enumerate(self.tables)], axis=1)

    def maps(self, x: np.ndarray) -> list[np.ndarray]:
        """One (positions, filters) map a width; x ends with two padding rows."""
        n = len(x) - 2
        return [sum(x[o : o + n] @ w[o] for o in range(len(w))) + b for w, b in zip(self.w, self.b, strict=True)]

    def logits(self, texts: list[np.ndarray], chunk: int = 1 << 16) -> np.ndarray:
        """Pooled over whole texts; positions are worked through in chunks of bounded memory."""
        pooled = np.zeros((len(texts), len(WIDTHS), self.filters), np.float32)  # ReLU: nothing is below zero
        gap = np.full((2, len(PARTS)), PAD, dtype=np.int64)
        run, owner, held = [], [], 0

        def flush() -> None:
            nonlocal held
            if run:
                starts = np.cumsum([0] + [len(r) for r in run[:-1]])
                spans = np.stack((starts, starts + [len(r) - 2 for r in run]), 1).ravel()  # windows start at words, not in the gaps
                for k, m in enumerate(self.maps(self.embed(np.concatenate([*run, gap])))):
                    np.maximum.at(pooled[:, k], np.array(owner), np.maximum.reduceat(m, spans, axis=0)[::2])
            run.clear(), owner.clear()
            held = 0

        for i, c in enumerate(texts):
            c = c.astype(np.int64)
            for at in range(0, len(c), chunk):  # two codes overlap, so no window is lost at a seam
                part = np.concatenate((c[at : at + chunk + 2], gap))
                run.append(part), owner.append(i)
                held += len(part)
                if held >= chunk:
                    flush()
        flush()
        return np.einsum("nwf,wf->n", pooled, self.out) + self.bias

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(texts) + b, -30, 30)))

    def train(self, texts: list[np.ndarray], y: np.ndarray, epochs: int = 6, rate: float = 0.05, batch: int = 32, seed: int = 5) -> None:
        """Adagrad over the winning windows of each filter."""
        rng, order = np.random.default_rng(seed), np.arange(len(y))
        acc, dim = np.full_like(self.tables, 1e-3), self.dim
        acc_w, acc_b, acc_o, acc_c = [np.full_like(w, 1e-3) for w in self.w], np.full_like(self.b, 1e-3), np.full_like(self.out, 1e-3), 1e-3
        share = np.clip(y.mean(), 0.02, 0.98)
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        padded = [np.concatenate((t.astype(np.int64), np.full((2 if len(t) else 3, len(PARTS)), PAD))) for t in texts]
        for _ in range(epochs):
            rng.shuffle(order)
            for at in range(0, len(order), batch):
                gw, gb, go, gc = [np.zeros_like(w) for w in self.w], np.zeros_like(self.b), np.zeros_like(self.out), 0.0
                rows, grads = [], []
                for i in order[at : at + batch]:
                    c = padded[i]
                    x = self.embed(c)
                    maps = self.maps(x)
                    best = [m.argmax(0) for m in maps]
                    top = np.stack([m.max(0) for m in maps])
                    act = np.maximum(top, 0)
                    g = weight[i] * (1 / (1 + np.exp(-np.clip((act * self.out).sum() + self.bias, -30, 30))) - y[i])
                    go += g * act
                    gc += g
                    back = g * self.out * (top > 0)
                    gb += back
                    for k, w in enumerate(self.w):
                        for o in range(len(w)):
                            at_o = best[k] + o
                            gw[k][o] += x[at_o].T * back[k]
                            rows.append(c[at_o])
                            grads.append((w[o] * back[k]).T)
                for k in range(len(self.w)):
                    acc_w[k] += gw[k] ** 2
                    self.w[k] -= rate * gw[k] / np.sqrt(acc_w[k])
                acc_b += gb**2
                self.b -= rate * gb / np.sqrt(acc_b)
                acc_o += go**2
                self.out -= rate * go / np.sqrt(acc_o)
                acc_c += gc**2
                self.bias -= np.float32(rate * gc / np.sqrt(acc_c))
                c, g = np.concatenate(rows), np.concatenate(grads)
                g, c = g[c[:, 0] < PAD], c[c[:, 0] < PAD]
                for k, table in enumerate(self.tables):
                    u, inverse = np.unique(c[:, k], return_inverse=True)
                    total = np.zeros((len(u), dim), np.float32)
                    np.add.at(total, inverse, g[:, k * dim : (k + 1) * dim])
                    acc[k][u] += total**2
                    table[u] -= 2 * rate * total / np.sqrt(acc[k][u])


def fit(rows: list[tuple[str, int, str]], epochs: int = 6) -> ConvNet | None:
    """Train on (text, label, lang); every fifth row is held out for the Platt scale and the thresholds by language.

    None unless both classes are there. Languages only choose the extra threshold, never the score.
    """
    y = np.array([r[1] for r in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        return None
    texts, held = codes([r[0] for r in rows]), np.arange(len(rows)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    use = np.flatnonzero(~held)
    net = ConvNet()
    net.train([texts[i] for i in use], y[use], epochs)
    check = np.flatnonzero(held if held.any() else ~held)
    net.scale = platt(net.logits([texts[i] for i in check]).astype(float), y[check])
    p = net.scores([texts[i] for i in check])
    langs = np.array([rows[i][2] or "" for i in check])
    for lang in sorted(set(langs)):
        own = langs == lang
        net.thresholds[lang] = best_threshold(p[own], y[check][own])
    return net


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Score with the best F1, halfway to the next one below; 0.5 where one class is missing."""
    if len(set(y.tolist())) < 2:
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    low = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + low) / 2)


def train(docs: DataFrame, labels: DataFrame, bound: int = 3000, folds: int = 5) -> ConvNet | None:
    """Fit on at most `bound` labelled rows, none of them with crc32(doc_id) mod folds = 0."""
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) != 0
    rows = labelled_sample(docs, labels, "toxic", bound, ("lang",), learn)
    return fit([(r["text"], r["label"], r["lang"]) for r in rows])


def classify(docs: DataFrame, net: ConvNet | None, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted, lang_threshold, lang_predicted for every row of docs.

    The score is that of the whole text alone. predicted cuts it at 0.5, lang_predicted at the threshold
    calibrated for the row's language (0.5 for unknown ones). Null and empty texts are scored as having
    no words; without a trained net every score is 0. held_out is null where doc_id is. Map-only.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)
    thresholds = net.thresholds if net else {}

    def run(parts: pd.Series) -> pd.Series:
        if sent.value is None:
            return pd.Series(np.zeros(len(parts)))
        return pd.Series(sent.value.scores(codes(list(parts))).astype(float))

    lang = F.col("lang").cast("string")
    limit = F.lit(0.5)
    for name, cut in sorted(thresholds.items()):
        limit = F.when(lang == name, F.lit(cut)).otherwise(limit)
    doc_id = F.col("doc_id").cast("long")
    scored = docs.select(doc_id.alias("doc_id"), limit.alias("lang_threshold"), F.pandas_udf(run, "double")(F.col("text").cast("string")).alias("score"))
    return scored.select(
        "doc_id",
        (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "lang_threshold",
        (F.col("score") >= F.col("lang_threshold")).cast("int").alias("lang_predicted"),
    )

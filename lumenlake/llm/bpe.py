"""Byte-level BPE encoding and decoding."""

from __future__ import annotations

import base64
import hashlib
import json
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

#: Words in each of the two generations that a worker remembers. A full young one becomes the old one and
#: words in use move back from there, so memory is bounded for any corpus and frequent words stay.
REMEMBERED = 250_000


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """Merged bytes -> rank, from a file with base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def fold(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of least rank (the leftmost of equal ones) until none has a rank."""
    whole = rank.get(word)
    if whole is not None:
        return [whole]
    parts = [word[k : k + 1] for k in range(len(word))]
    none = 1 << 60
    near = [rank.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while near and (least := min(near)) < none:
        k = near.index(least)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        near.pop(k)
        if k < len(near):
            near[k] = rank.get(parts[k] + parts[k + 1], none)
        if k:
            near[k - 1] = rank.get(parts[k - 1] + parts[k], none)
    return [rank[p] for p in parts]


def fold_long(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The same merges for very long words in O(n log n): a heap of pairs over linked parts."""
    from heapq import heapify, heappop, heappush

    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, k, k + 1, k + 2) for k in range(n - 1) if (r := rank.get(word[k : k + 2])) is not None]
    heapify(heap)
    while heap:
        _, a, b, stop = heappop(heap)
        if not (alive[a] and b < n and alive[b] and after[a] == b and end[b] == stop):
            continue
        end[a], after[a], alive[b] = end[b], after[b], False
        if after[a] < n:
            before[after[a]] = a
            if (r := rank.get(word[a : end[after[a]]])) is not None:
                heappush(heap, (r, a, after[a], end[after[a]]))
        if (p := before[a]) >= 0 and (r := rank.get(word[p : end[a]])) is not None:
            heappush(heap, (r, p, a, end[a]))
    return [rank[word[k : end[k]]] for k in range(n) if alive[k]]


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.rank = ranks(path)
        self.pieces = {i: b for b, i in self.rank.items()}
        self.split = regex.compile(pattern)
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.old: dict[str, tuple[int, str, bytes]] = {}

    def word(self, word: str) -> tuple[int, str, bytes]:
        """Of one word: the number of ids, the ids comma-joined, and the bytes that they decode to."""
        made = self.old.get(word)
        if made is None:
            data = word.encode("utf-8")
            ids = fold(data, self.rank) if len(data) < 256 else fold_long(data, self.rank)
            made = (len(ids), ",".join(map(str, ids)), self.decode(ids))
        if len(word) < 256:
            if len(self.known) >= REMEMBERED:
                self.known, self.old = {}, self.known
            self.known[word] = made
        return made

    def words(self, text: str) -> list[tuple[int, str, bytes]]:
        word = self.word
        return [self.known.get(w) or word(w) for w in self.split.findall(text)]

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.words(text) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, out: str = "ids") -> DataFrame:
    """docs with `out`, the token ids of each whole text; a null text has none. Map-only, in Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        return pd.Series([np.array(c.encode(t or ""), dtype=np.int32) for t in texts], dtype=object)

    return docs.withColumn(out, F.pandas_udf(run, "array<int>")(F.col("text").cast("string")))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with `out`, the bytes of the ids: the tokens' pieces one after another; null for null, empty for none."""

    def run(rows: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        return pd.Series([None if r is None else c.decode(r.tolist()) for r in rows], dtype=object)

    return docs.withColumn(out, F.pandas_udf(run, "binary")(F.col(ids)))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs.

    Null texts are empty ones (no tokens); the digest is of the empty string then. Repeated rows are kept.
    The ids never leave the worker: encoding, decoding and both digests are one Arrow pass.
    """

    def run(texts: pd.Series) -> pd.DataFrame:
        c, rows = codec(path, pattern), []
        for t in texts:
            made = c.words(t or "")
            said = hashlib.sha256(",".join([m[1] for m in made]).encode()).hexdigest()
            rows.append((sum(m[0] for m in made), said, hashlib.sha256(b"".join([m[2] for m in made])).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pandas_udf(run, kind)(F.col("text").cast("string")).alias("d"))
    return made.select("doc_id", "d.*")


# --- the same fold in higher-order functions ---------------------------------------------------------


def fold_column(word: Column, path: str, buckets: int = 4096) -> Column:
    """Token ids of a binary column by a fold of ranked merges, in higher-order functions only.

    Bytes are held as ISO-8859-1 characters. The rank map is a literal, an array of small maps by a hash
    of the key, since a look-up goes through a map from its start. See README for when this is used.
    """
    rank = ranks(path)
    cells: list[dict[str, int]] = [{} for _ in range(buckets)]
    for token, r in rank.items():
        key = token.decode("latin-1")
        cells[xxh64_intdigest(key.encode("utf-8"), 42) % buckets][key] = r
    table = F.from_json(F.lit(json.dumps(cells)), "array<map<string,int>>")

    def look(key: Column) -> Column:
        cell = F.pmod(F.xxhash64(key), F.lit(buckets))  # a power of two: the same for signed and unsigned
        return F.coalesce(F.try_element_at(F.get(table, cell.cast("int")), key), F.lit(1 << 30))

    chars = F.decode(word, "ISO-8859-1")
    start = F.filter(F.split(chars, ""), lambda c: c != "")

    def step(parts: Column, _: Column) -> Column:
        near = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: look(F.concat(F.element_at(parts, k), F.element_at(parts, k + 1))))
        least = F.array_min(near)
        k = F.array_position(near, least).cast("int")
        merged = F.concat(F.slice(parts, F.lit(1), k - 1), F.array(F.concat(F.element_at(parts, k), F.element_at(parts, k + 1))), F.slice(parts, k + 2, F.size(parts)))
        return F.when(F.size(parts) < 2, parts).when(least >= (1 << 30), parts).otherwise(merged)

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(chars), F.lit(1))), start, step)
    return F.transform(folded, look)

"""Deduplication of repeated passages: every repeated span of 50 words, wherever it begins, and runs of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.llm.spans import UNSPACED, WORD, mix, powers, sliding
from lumenlake.sources.scratch import materialise

#: Words of a span, words of a shingle, and shingles in a span.
SPAN, SHINGLE = 50, 20
REACH = SPAN - SHINGLE + 1
#: A sentence of the runs: up to 16 words, the marks that close it and the white space after it.
PIECE = re.compile(r"(?:[^\x09-\x0D .!?]+[ \t]*){1,16}[.!?]*[\x09-\x0D ]*|[.!?]+[\x09-\x0D ]*|[\x09-\x0D ]+")
BLANKS = re.compile(r"[\x09-\x0D ]+")
MARK = "h1 long, h2 long, doc_id long, row_key long, lo int, hi int"


class Hashes(dict):
    """64-bit hashes of lower-cased words, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = int.from_bytes(blake2b(word.lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


def rolling(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each n neighbours of h."""
    bits = len(h).bit_length()
    up, down = powers(base, bits)[: len(h)], powers(pow(base, -1, 1 << 64), bits)[: len(h)]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up)))
    return mix((sums[n:] - sums[:-n]) * down[: len(h) - n + 1])


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the shingles that are the smallest of some span (winnowing).

    Which shingles of a span are chosen follows from its words alone, and each span has one: two places
    with the same span have the same anchor in it.
    """
    if len(h) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    shingles = rolling(h, SHINGLE, 0x9E3779B97F4A7C15)
    least = sliding(np.minimum, shingles, REACH)
    edge = np.zeros(REACH - 1, np.uint64)
    places = np.flatnonzero(shingles == sliding(np.maximum, np.concatenate((edge, least, edge)), REACH))
    return places, shingles[places]


def word_hashes(words: list[str], known: Hashes) -> np.ndarray:
    return np.fromiter((known[w] for w in words), np.uint64, len(words))


def sentence_runs(text: str, run: int = 3, min_words: int = 6) -> Iterator[tuple[bytes, int, int]]:
    """Digest, first and last character of each run of `run` sentences, made longer until it has min_words words."""
    pieces = PIECE.findall(text)
    plain = [BLANKS.sub(" ", p.lower()).strip(" ") for p in pieces]
    words = [p.count(" ") + 1 if p else 0 for p in plain]
    ends = [0, *np.cumsum([len(p) for p in pieces]).tolist()]
    for i in range(len(pieces) - run + 1):
        n, j = sum(words[i : i + run]), i + run
        while n < min_words and j < len(pieces):
            n, j = n + words[j], j + 1
        if n >= min_words:
            yield blake2b("\n".join(plain[i:j]).encode("utf-8", "surrogatepass"), digest_size=16).digest(), ends[i], ends[j]


def rows_of(batch: pa.RecordBatch) -> Iterable[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def marks(schema: pa.Schema, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """One batch of (h1, h2, doc_id, row_key, lo, hi) from such parts of (h1, h2, lo, hi arrays, doc_id, row_key)."""
    if parts:
        n = [len(p[0]) for p in parts]
        flat = [np.concatenate([np.asarray(p[k]) for p in parts]) for k in range(4)]
        ids = pa.array([p[4] for p in parts], pa.int64()).take(pa.array(np.repeat(np.arange(len(parts)), n)))
        keys = np.repeat(np.array([p[5] for p in parts], np.int64), n)
        yield pa.RecordBatch.from_arrays([pa.array(flat[0].view(np.int64)), pa.array(flat[1].view(np.int64)), ids, pa.array(keys), pa.array(flat[2].astype(np.int32)), pa.array(flat[3].astype(np.int32))], schema=schema)


SCHEMA = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def anchor_marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, row_key, text to the anchors; lo is the word."""
    known = Hashes()
    for batch in batches:
        parts = []
        for doc_id, key, text in rows_of(batch):
            places, h = anchors(word_hashes(WORD.findall(text), known))
            if len(places):
                parts.append((h, np.zeros(len(h), np.uint64), places, places, doc_id, key))
        yield from marks(SCHEMA, parts)


def run_marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, row_key, text to the runs of sentences."""
    for batch in batches:
        parts = []
        for doc_id, key, text in rows_of(batch):
            found = list(sentence_runs(text))
            if found:
                h = np.frombuffer(b"".join(x[0] for x in found), np.uint64).reshape(-1, 2)
                parts.append((h[:, 0].copy(), h[:, 1].copy(), [x[1] for x in found], [x[2] for x in found], doc_id, key))
        yield from marks(SCHEMA, parts)


def span_marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, row_key, text, places of repeated anchors to the spans that may be repeated: their anchor is."""
    known = Hashes()
    for batch in batches:
        parts = []
        for doc_id, key, text, repeated in rows_of(batch):
            at = [m.span() for m in WORD.finditer(text)]
            h = word_hashes([text[a:b] for a, b in at], known)
            shingles = rolling(h, SHINGLE, 0x9E3779B97F4A7C15)
            start = np.flatnonzero(np.isin(sliding(np.minimum, shingles, REACH), shingles[repeated]))
            if len(start):
                begins = np.array([a for a, _ in at] + [len(text)])
                h2 = rolling(mix(h + np.uint64(0x2545F4914F6CDD1D)), SPAN, 0xD1342543DE82EF95)
                parts.append((rolling(h, SPAN, 0xBF58476D1CE4E5B9)[start], h2[start], begins[start], begins[start + SPAN], doc_id, key))
        yield from marks(SCHEMA, parts)


def repeats(found: DataFrame) -> DataFrame:
    """h1, h2, first: the marks with more than one place, and their smallest place of the whole table."""
    where = F.struct("doc_id", "row_key", "lo")
    return found.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.max(where).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first")


def later(found: DataFrame, label: str) -> DataFrame:
    """row_key, lo, hi of the marks that are not the first of their kind."""
    first = materialise(repeats(found), label)
    where = F.struct("doc_id", "row_key", "lo")
    return found.join(first, ["h1", "h2"]).where(~where.eqNullSafe(F.col("first"))).select("row_key", "lo", "hi")


def cut(text: str | None, covered: list | None) -> tuple[str | None, int, int]:
    """The text without the covered characters, its words, and those of them that begin in a covered place."""
    if text is None or not covered:
        return text, len(WORD.findall(text or "")), 0
    kept, at, merged = [], 0, []
    for lo, hi in sorted((c["lo"], c["hi"]) for c in covered):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    for lo, hi in merged:
        kept.append(text[at:lo])
        at = hi
    starts = np.array([m.start() for m in WORD.finditer(text)])
    gone = sum(int(np.searchsorted(starts, hi) - np.searchsorted(starts, lo)) for lo, hi in merged)
    return "".join([*kept, text[at:]]), len(starts), gone


def dedup_passages(docs: DataFrame) -> DataFrame:
    """All columns of docs with text without its repeated passages, then n_words and n_removed (words).

    A passage is a span of 50 words, compared in lower case whatever the white space between them and the
    sentences around them, or a run of 3 sentences with 6 words; shorter sentences make a longer run. The smallest
    (doc_id, row, place) of a passage stays, all others go. Rows with equal doc_id and text are one document.
    Rows and repeated rows all stay; a null text stays null.
    """
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("row_key"), text.alias("text"))
    found = materialise(base.mapInArrow(anchor_marks, MARK), "passage-anchors")
    twice = materialise(repeats(found).select("h1", "h2"), "passage-repeated")
    places = found.join(twice, ["h1", "h2"], "left_semi").groupBy("row_key").agg(F.collect_set("lo").alias("places"))
    wide = base.join(materialise(places, "passage-places"), "row_key").select("doc_id", "row_key", "text", "places")
    spans = materialise(wide.mapInArrow(span_marks, MARK), "passage-spans")
    runs = materialise(base.mapInArrow(run_marks, MARK), "passage-runs")
    gone = later(spans, "passage-span-first").unionByName(later(runs, "passage-run-first"))
    covered = gone.groupBy("row_key").agg(F.collect_set(F.struct("lo", "hi")).alias("_covered"))
    covered = materialise(covered.withColumnRenamed("row_key", "_key"), "passage-covered")
    keyed = docs.select(*[F.col(f"`{c}`") for c in columns], F.xxhash64("doc_id", text).alias("_key"))
    out = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    made = F.udf(cut, out, useArrow=True)(F.col("text").cast("string"), F.col("_covered"))
    joined = keyed.join(covered, "_key", "left").withColumn("_made", made)
    return joined.select(*[F.col("_made.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in columns], "_made.n_words", "_made.n_removed")

"""Substring deduplication by sliding runs of sentences.

A sentence ends with a word that closes it (. ! ? and their like). A long one goes on in further sentences:
of each WINDOW neighbouring words without a closing one, the word with the smallest hash closes a sentence
too. Where a text is cut so follows from the words around the cut alone, never from a count from the start,
so a passage is cut alike wherever it stands, and every span of 50 words holds a whole run.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.names import fresh, quoted
from lumenlake.sources.scratch import discard, materialise

#: Words among which one closes a sentence, and the least sentences and words of a run.
WINDOW, RUN, LEAST = 10, 2, 12
#: Scripts written without spaces: each of their characters is a word.
UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff"
WORD = re.compile(rf"[{UNSPACED}]|[^\x09-\x0D {UNSPACED}]+")
DENSE = re.compile(rf"[{UNSPACED}]")
CLOSING = re.compile(r"""[.!?。！？]["')\]”’»]*$""")
MARKS = "h1 long, h2 int, ident long, row_key int, place long"
SCHEMA = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("ident", pa.int64()), ("row_key", pa.int32()), ("place", pa.int64())])
#: A place is a run's first sentence times this, and its number of sentences.
SPAN = 64
BASE, OTHER = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


class Hashes(dict):
    """UTF-8 word -> 60 bits of the MD5 of its lower case, then whether it closes a sentence; kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        low = word.decode("utf-8", "surrogatepass").lower()
        value = int(md5(low.encode("utf-8", "surrogatepass")).hexdigest()[:15], 16) << 4 | bool(CLOSING.search(low))
        self[word] = value
        return value


@cache
def remembered() -> Hashes:
    """The hashes that a worker keeps from batch to batch."""
    return Hashes()


def words_of(text: str) -> list[bytes]:
    if DENSE.search(text):
        return [w.encode("utf-8", "surrogatepass") for w in WORD.findall(text)]
    return text.encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only


def hashes_of(words: list[bytes], known: Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def sliding(op: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """op over each n neighbours of x."""
    size, k = len(x), 1
    while 2 * k <= n:
        x, k = op(x[:-k], x[k:]), 2 * k
    return op(x[: size - n + 1], x[n - k :])


def bounds(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """First word of each sentence, then the number of words; of no words just 0."""
    if not len(h):
        return np.zeros(1, np.int64)
    rank = np.where(h & np.uint64(1), np.uint64(0), h)  # a closing word is the smallest of any window
    closes = rank == 0
    if len(h) >= window:
        edge = np.zeros(window - 1, np.uint64)
        closes |= rank == sliding(np.maximum, np.concatenate((edge, sliding(np.minimum, rank, window), edge)), window)
    closes[-1] = True
    return np.concatenate((np.zeros(1, np.int64), np.flatnonzero(closes) + 1))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@cache
def powers(base: int, bits: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full((1 << bits) - 1, base, np.uint64))))


def between(h: np.ndarray, first: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of the words first..end of h, for many spans at once, from running sums."""
    bits = len(h).bit_length()
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers(base, bits)[: len(h)])))
    return mix((sums[end] - sums[first]) * powers(pow(base, -1, 1 << 64), bits)[first] + (end - first).astype(np.uint64) * np.uint64(OTHER))


def runs(b: np.ndarray, run: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, end sentence, first word, end word: from every sentence `run` of them, more until they hold `least` words."""
    lo = np.arange(len(b) - 1)
    hi = np.maximum(lo + run, np.searchsorted(b, b[:-1] + least))
    held = hi < len(b)
    lo, hi = lo[held], hi[held]
    return lo, hi, b[lo], b[hi]


def marks(batches: Iterable[pa.RecordBatch], run: int, least: int, window: int) -> Iterator[pa.RecordBatch]:
    """ident, row_key, text to a row for each run, and a row without h1 for each text whose place is its number of sentences."""
    known = remembered()
    for batch in batches:
        parts, sentences = [], []
        for row, text in enumerate(batch.column(2).to_pylist()):
            h = hashes_of(words_of(text), known)
            b = bounds(h, window)
            sentences.append(len(b) - 1)
            lo, hi, first, end = runs(b, run, least)
            if len(lo):
                h1 = between(h, first, end, BASE)
                parts.append((row, h1, between(mix(h ^ np.uint64(OTHER)), first, end, BASE), lo * SPAN + (hi - lo)))
        none = pa.nulls(len(sentences), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none.cast(pa.int32()), batch.column(0), batch.column(1), pa.array(sentences, pa.int64())], schema=SCHEMA)
        if not parts:
            continue
        h1 = pa.array(np.concatenate([p[1] for p in parts]).view(np.int64))
        of = pa.array(np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]))
        h2 = pa.array((np.concatenate([p[2] for p in parts]) >> np.uint64(32)).astype(np.uint32).view(np.int32))
        place = pa.array(np.concatenate([p[3] for p in parts]).astype(np.int64))
        yield pa.RecordBatch.from_arrays([h1, h2, batch.column(0).take(of), batch.column(1).take(of), place], schema=SCHEMA)


def identity() -> tuple[Column, Column]:
    """(ident, row_key) of a row: its doc_id, for a null one a number below 0 made from the text; 32 more bits of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.coalesce(F.col("doc_id").cast("long"), -1 - F.shiftrightunsigned(F.xxhash64(text), 1)), F.hash(text)


def occurrences(docs: DataFrame, run: int = RUN, least: int = LEAST, window: int = WINDOW) -> DataFrame:
    """h1, h2 (96 bits of a run's words), ident, row_key, place: every run of the texts of docs (ident, row_key, text), and each text's number of sentences."""
    if max(run, least) >= SPAN:
        raise ValueError(f"run and least have to be below {SPAN}")
    work = lambda batches: marks(batches, run, least, window)
    return docs.select("ident", "row_key", "text").mapInArrow(work, MARKS)


def repeated_spans(docs: DataFrame, run: int = RUN, least: int = LEAST, window: int = WINDOW) -> DataFrame:
    """ident, row_key, n, covered: of each row the number of sentences and the places of its runs that are not the first of their kind in the whole table.

    docs: ident, row_key, text. The first is the smallest (ident, row_key, sentence); a later one may stand in
    the same text. Counts of 64-bit keys, added up in the tasks, tell the keys that come twice; only their
    runs are kept, told apart by the other 32 bits. A text's repeated runs without those of them that are a
    first are its later ones. The join meets on plain exchanges, so that adaptive execution splits a run that very
    many texts hold; first places are added up in the tasks.
    """
    every = materialise(occurrences(docs, run, least, window), "span-runs")  # texts are cut and hashed once
    sentences = every.where("h1 is null").groupBy("ident", "row_key").agg(F.max("place").alias("n"))
    twice = materialise(every.where("h1 is not null").groupBy("h1").count().where("count > 1").select("h1"), "span-keys")
    hits = materialise(every.join(twice.hint("merge"), "h1", "left_semi"), "span-hits")
    where = F.struct("ident", "row_key", "place")
    first = hits.groupBy("h1", "h2").agg(F.min(where).alias("first")).select("first.*", F.lit(True).alias("is_first"))
    both = hits.select("ident", "row_key", "place", F.lit(False).alias("is_first")).unionByName(first)
    own = both.groupBy("ident", "row_key").agg(F.collect_set("place").alias("all"), F.collect_set(F.when(F.col("is_first"), F.col("place"))).alias("firsts"))
    later = own.select("ident", "row_key", F.array_except("all", "firsts").alias("covered")).where(F.size("covered") > 0)
    made = materialise(sentences.join(later.hint("merge"), ["ident", "row_key"], "left"), "span-covered")
    discard(every, twice, hits)
    return made


def cut(text: str | None, n: int, lo: np.ndarray, hi: np.ndarray, known: Hashes, window: int = WINDOW) -> tuple[str | None, int, int]:
    """The text of n sentences without those of the runs lo..hi (each goes with the white space after it), n, and how many went.

    Only texts that lose a part are cut into sentences again.
    """
    if not text or not len(lo) or not n:
        return text, n if text else 0, 0
    deep = np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1)
    gone = np.cumsum(deep)[:n] > 0
    if gone.all():
        return "", n, n
    b = bounds(hashes_of(words_of(text), known), window)
    whole = text if DENSE.search(text) else text.encode("utf-8", "surrogatepass")
    turns = np.flatnonzero(np.diff(gone, prepend=True, append=True))  # where what stays begins and ends, in turns
    at = np.concatenate((beginnings(whole), [len(whole)]))[b]
    at[0] = 0
    kept = [whole[i:j] for i, j in at[turns].reshape(-1, 2).tolist()]
    return "".join(kept) if isinstance(whole, str) else b"".join(kept).decode("utf-8", "surrogatepass"), n, int(gone.sum())


def beginnings(text: str | bytes) -> np.ndarray:
    """Where each word begins; in bytes only white space parts words."""
    if isinstance(text, str):
        return np.array([m.start() for m in WORD.finditer(text)], np.int64)
    data = np.frombuffer(text, np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    return np.flatnonzero(inside[1:] > inside[:-1]) + 1 if not inside[0] else np.concatenate(([0], np.flatnonzero(inside[1:] > inside[:-1]) + 1))


def dedup_spans(docs: DataFrame, run: int = RUN, least: int = LEAST, window: int = WINDOW) -> DataFrame:
    """All columns of docs with text without its repeated sentences, then n_sentences and n_removed (long).

    Sentences are compared by their words in lower case, whatever the white space between them. Rows and
    repeated rows all stay; rows with equal doc_id and text are one document, rows without a doc_id come first. A
    text whose every sentence is a repeat becomes empty; a null text stays null and an empty one empty, with no
    sentences; texts without repeats are unchanged. Columns n_sentences and n_removed of docs are replaced.
    """
    columns = [c for c in docs.columns if c.lower() not in ("n_sentences", "n_removed")]
    ident, key, n, covered, made = fresh(docs, "ident", "row_key", "n", "covered", "made")
    one, two = identity()
    base = docs.select(one.alias("ident"), two.alias("row_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = repeated_spans(base, run, least, window).toDF(ident, key, n, covered)
    keyed = docs.select(*[F.col(quoted(c)) for c in columns], one.alias(ident), two.alias(key))

    def batch(texts: pa.Array, sentences: pa.Array, hits: pa.Array) -> pa.Array:
        ends = np.cumsum(hits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        place = hits.flatten().to_numpy()
        lo, hi = place // SPAN, place // SPAN + place % SPAN
        rows = [cut(t, k, lo[a:b], hi[a:b], remembered(), window) for t, k, a, b in zip(texts.to_pylist(), sentences.fill_null(0).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))], ["text", "n_sentences", "n_removed"])

    cutting = F.arrow_udf(batch, "struct<text:string,n_sentences:long,n_removed:long>")
    done = keyed.join(marked.hint("merge"), [ident, key], "left").withColumn(made, cutting(F.col("text").cast("string"), F.col(n), F.col(covered)))
    out = [F.col(f"{made}.text").alias(c) if c.lower() == "text" else F.col(quoted(c)) for c in columns]
    return done.select(*out, f"{made}.n_sentences", f"{made}.n_removed")

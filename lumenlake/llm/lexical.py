"""Ranked lexical search: MaxScore with bounds for pairs of terms, over blocks of documents."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenlake.sources.scratch import discard, materialise

#: Terms (fixed values): in characters, and the same over UTF-8 bytes of lower-cased text.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents in a block of the index, and distinct terms of the items that are searched in one pass (one item may hold more).
BLOCK, TERMS_A_PASS = 2048, 500_000


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item; rows of one item_id are one item, and null texts have none."""
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tfs of every document with at least one term: all its terms counted, those of the vocabulary listed."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = TERM_BYTES.findall(text.as_buffer().to_pybytes().lower()) if text.is_valid else ()
                if found:
                    held = [(known[t], tf) for t, tf in Counter(found).items() if t in known]
                    rows.append((key, len(found), [h[0] for h in held], [h[1] for h in held]))
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Items:
    """Items of one pass: their terms by ascending weight, and the pairs of neighbours in that order.

    items: item_id -> numbers of terms; weight by number (0: the term adds nothing).
    """

    def __init__(self, items: dict, weight: np.ndarray, k: int):
        self.ids = list(items)
        self.weight, self.k = weight, k
        self.terms = [np.array(sorted((t for t in ts if weight[t] > 0), key=lambda t: (weight[t], t)), dtype=np.int64) for ts in items.values()]
        both = sorted({(int(a), int(b)) for ts in self.terms for a, b in zip(ts, ts[1:], strict=False)})
        self.pairs = np.array(both, dtype=np.int64).reshape(-1, 2)
        number = {p: i for i, p in enumerate(both)}
        self.pair = [np.array([number[int(a), int(b)] for a, b in zip(ts, ts[1:], strict=False)], dtype=np.int64) for ts in self.terms]


class Lists:
    """The inverted lists of a block: for each term the places of its documents and their impacts."""

    def __init__(self, terms: np.ndarray, starts: np.ndarray, places: np.ndarray, impacts: np.ndarray):
        self.at = {int(t): k for k, t in enumerate(terms)}
        self.starts, self.places, self.impacts = starts, places, impacts

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray] | None:
        k = self.at.get(term)
        return None if k is None else (self.places[self.starts[k] : self.starts[k + 1]], self.impacts[self.starts[k] : self.starts[k + 1]])


def inverted(terms: np.ndarray, tfs: np.ndarray, place: np.ndarray, m: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """terms, starts, places, impacts of a block's postings, without those of no weight."""
    impact = weight[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[place]))
    keep = impact > 0
    terms, place, impact = terms[keep], place[keep], impact[keep]
    order = np.argsort(terms, kind="stable")
    found, first = np.unique(terms[order], return_index=True)
    return found, np.append(first, len(order)), place[order], impact[order]


def joint_maxima(items: Items, lists: Lists, size: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Pairs that meet in a document of the block, the largest sum of both impacts, and for each item a score that k documents reach (0: fewer do).

    The score comes from every second pair of the item: no term is counted twice, so it is a lower bound.
    """
    mark, most, lists_of = np.zeros(size, dtype=np.int64), np.zeros(len(items.pairs), dtype=np.int64), {}
    last = None
    for number, (a, b) in enumerate(items.pairs.tolist()):
        one, two = lists.of(a), lists.of(b)
        if one is None or two is None:
            continue
        if a != last:
            mark[:] = 0
            mark[one[0]], last = one[1], a
        joint = mark[two[0]]
        both = joint > 0
        if both.any():
            lists_of[number] = (two[0][both], joint[both] + two[1][both])
            most[number] = lists_of[number][1].max()
    floors = []
    for pair in items.pair:
        total = np.zeros(size, dtype=np.int64)
        for number in pair[::2].tolist():
            if number in lists_of:
                places, joint = lists_of[number]
                total[places] += joint
        floors.append(int(np.partition(total, size - items.k)[size - items.k]) if size >= items.k else 0)
    met = np.flatnonzero(most)
    return met, most[met], floors


INDEX = "doc_ids array<long>, terms array<int>, starts array<int>, places array<int>, impacts array<long>, pairs array<int>, joint array<long>, floors array<long>"


def build_index(counts: DataFrame, items: Items, documents: int, terms: int) -> DataFrame:
    """One row a block of documents: lists with impacts, joint maxima of the pairs, and what score k documents reach for each item."""
    shared = counts.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, pa.list_(pa.int64() if kind == "array<long>" else pa.int32())) for name, kind in (c.split(" ") for c in INDEX.split(", "))])
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                n = part.column(1).to_numpy()
                m = 50 + (50 * n * documents) // terms
                flat = [part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3)]
                place = np.repeat(np.arange(part.num_rows), part.column(2).value_lengths().to_numpy())
                made = inverted(flat[0].astype(np.int64), flat[1].astype(np.int64), place, m, shared.value.weight)
                pairs, joint, floors = joint_maxima(shared.value, Lists(*made), part.num_rows)
                row = [part.column(0).to_pylist(), *made, pairs, joint, floors]
                yield pa.RecordBatch.from_arrays([pa.array([r], f.type) for r, f in zip(row, schema, strict=True)], schema=schema)

    return counts.mapInArrow(run, INDEX)


def bounds(single: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """For each number of terms, from the lightest, the highest score that a document of these terms alone may have.

    single: largest impact of each term; joint: of each neighbouring pair in one document (0: they never meet).
    A pair adds at most the larger of joint and both singles, which is never more than the sum of the singles.
    """
    out = np.zeros(len(single) + 1, dtype=np.int64)
    for j, alone in enumerate(single.tolist()):
        out[j + 1] = out[j] + alone
        if j:
            out[j + 1] = min(out[j + 1], out[j - 1] + max(int(joint[j - 1]), int(single[j - 1]), alone))
    return out


def search_block(terms: np.ndarray, pair: np.ndarray, lists: Lists, joint: dict[int, int], size: int, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the documents of a block that score at least `least` (1 or more), and at least what k of them do."""
    none = np.zeros(0, dtype=np.int64)
    held = [lists.of(int(t)) for t in terms]
    single = np.array([0 if h is None else h[1].max() for h in held], dtype=np.int64)
    bound = bounds(single, np.array([joint.get(int(p), 0) for p in pair], dtype=np.int64))
    if bound[-1] < least:
        return none, none
    total, j = np.zeros(size, dtype=np.int64), len(terms)
    while j and bound[j] >= least:  # essential lists: a document outside them cannot reach the score
        j -= 1
        if held[j] is not None:
            total[held[j][0]] += held[j][1]
    if j and size >= k:
        least = max(least, int(np.partition(total, size - k)[size - k]))
    alive = (total > 0) & (total + bound[j] >= least)
    while j and alive.any():
        j -= 1
        if held[j] is not None:
            near = alive[held[j][0]]
            total[held[j][0][near]] += held[j][1][near]
        alive &= total + bound[j] >= least
    found = np.flatnonzero(alive & (total >= least))
    return found, total[found]


def best(index: DataFrame, items: Items, floors: np.ndarray) -> DataFrame:
    """item_id, doc_id, score: of each task's documents those that may be among an item's k best, at most k."""
    shared = index.sparkSession.sparkContext.broadcast((items, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floors = shared.value
        k, least, kept = items.k, np.maximum(floors, 1), [[] for _ in items.ids]
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r].values for name in batch.schema.names}
                ids = row["doc_ids"].to_pylist()
                lists = Lists(*(row[c].to_numpy(zero_copy_only=False) for c in ("terms", "starts", "places", "impacts")))
                joint = dict(zip(row["pairs"].to_pylist(), row["joint"].to_pylist(), strict=True))
                for number, (terms, pair) in enumerate(zip(items.terms, items.pair, strict=True)):
                    places, scores = search_block(terms, pair, lists, joint, len(ids), int(least[number]), k)
                    if len(places):
                        have = kept[number] + [(-s, ids[p] is None, ids[p] or 0) for p, s in zip(places.tolist(), scores.tolist(), strict=True)]
                        have.sort()
                        del have[k:]
                        kept[number] = have
                        if len(have) == k:
                            least[number] = max(least[number], -have[-1][0])
        rows = [(items.ids[number], None if null else key, -s) for number, have in enumerate(kept) for s, null, key in have]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def _pass(docs: DataFrame, chosen: list, k: int) -> DataFrame | None:
    """The k best of each item of one pass; chosen: rows (item_id, term)."""
    spark, vocabulary = docs.sparkSession, {}
    items: dict = {}
    for r in chosen:
        items.setdefault(r["item_id"], []).append(vocabulary.setdefault(r["term"].encode("utf-8"), len(vocabulary)))
    counts = materialise(count_terms(docs, vocabulary), "lexical-counts")
    whole = counts.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    if not whole["documents"]:
        discard(counts)
        return None
    weight = np.zeros(len(vocabulary), dtype=np.int64)
    for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # no more rows than terms in the pass
        weight[r["term"]] = math.floor(1000 * math.log((2 * whole["documents"] + 2) / (2 * r["count"] + 1)))
    asked = Items(items, weight, k)
    index = materialise(build_index(counts, asked, whole["documents"], whole["terms"]), "lexical-index")
    floors = np.zeros(len(asked.ids), dtype=np.int64)
    for r in index.select(F.posexplode("floors").alias("item", "least")).groupBy("item").agg(F.max("least").alias("least")).collect():
        floors[r["item"]] = r["least"]
    found = materialise(best(index, asked, floors), "lexical-best")
    discard(counts, index)
    return found


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest scores above 0 for each item, equal scores by doc_id.

    Items are searched in passes of at most TERMS_A_PASS distinct terms (or of one item), and a pass is three
    steps: documents are counted once, blocks of documents get inverted lists with impacts and the joint maxima of
    term pairs, and each block is searched with a threshold that some block's pairs prove for all. Nothing is
    sampled: a list or a block is skipped only where its bound is below the threshold.

    Null and empty texts have no terms: such documents are not counted, such items have no rows. Repeated document
    rows are documents of their own; a null doc_id comes after the others among equal scores. Rows of one item_id
    (null too) are one item of all their terms. Other columns are not looked at.
    """
    schema = "item_id long, doc_id long, score long"
    wanted = materialise(item_terms(items), "lexical-items")
    sizes = wanted.agg(F.count("*").alias("n")).first()["n"]
    passes = max(1, -(-sizes // TERMS_A_PASS))
    found = []
    for number in range(passes if sizes else 0):
        chosen = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number).orderBy("item_id", "term").collect()
        if chosen and (part := _pass(docs, chosen, k)) is not None:
            found.append(part)
    discard(wanted)
    every = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return every.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

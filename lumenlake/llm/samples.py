"""Bounded samples of labelled documents for fitting the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.sources.scratch import materialise

#: Characters of all texts that a classifier is fitted on: what the driver holds, whatever the corpus.
ROOM = 40_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, columns: tuple[str, ...] = (), where=None, room: int = ROOM) -> list:
    """At most `bound` rows (doc_id, text, label, *columns) with at most `room` characters, half of each class where there are enough.

    Rows are chosen by a hash of doc_id, so the sample is the same on every run and at any partitioning.
    Only the chosen ids (a bounded set) are sent to the scan of docs.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).dropna()
    if where is not None:
        known = known.where(where)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound // 2)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *columns)
    one = F.min(F.struct("text", "label", *columns)).alias("row")  # rows that repeat an id count once, so the bound holds
    rows = materialise(texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(one).select("doc_id", "row.*"), "labelled-sample")
    sizes = rows.select("doc_id", F.length("text").alias("n"), F.xxhash64("doc_id").alias("h")).collect()
    fit = within([(r["h"], r["doc_id"], r["n"]) for r in sizes], room)
    return sorted(rows.where(F.col("doc_id").isin(fit)).collect(), key=lambda r: r["doc_id"]) if fit else []


def within(rows: list[tuple], room: int) -> list:
    """The ids of rows (hash, id, characters) in the order of their hash, without those that would make it more than `room` characters."""
    out, total = [], 0
    for _, key, n in sorted(rows):
        if total + n <= room:
            total += n
            out.append(key)
    return out

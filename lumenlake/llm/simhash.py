"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are dealt to buckets by one of `distance + 1` bit blocks: two fingerprints that differ in
at most `distance` bits agree on at least one whole block, so no link is lost. Inside a bucket the
fingerprints are sorted by Gray rank, runs of neighbours become tree nodes that hold the bits which all
their members share, and a search walks down the tree, adding the differences on each node's own shared
bits and dropping whole nodes once the sum is above the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenlake.llm.names import fresh, quoted
from lumenlake.operators.graph import connected_components
from lumenlake.sources.scratch import materialise

BITS = 64
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words: int = 4) -> int:
    """64 bits: each set if more than half of the shingles' XXH64 (seed 42) have it; 0 without words."""
    if not text:
        return 0
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(parts) > words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[s:e], 42) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], dtype="<u8")
    bits = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, row_key (a hash of id and text), fp (the 64 bits as a signed long). Map-only; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(2)), dtype="<u8", count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view("<i8"))], names=["doc_id", "row_key", "fp"])

    return docs.select(F.col("doc_id").cast("long"), row_key(), F.col("text").cast("string")).mapInArrow(run, "doc_id long, row_key long, fp long")


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the reflected Gray order: the prefix XOR of its bits."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Tree over distinct fingerprints of many buckets; fps must be sorted by (bucket, Gray rank).

    levels[0] are the fingerprints, each further level holds runs of `fanout` nodes of one bucket.
    """

    def __init__(self, buckets: np.ndarray, fps: np.ndarray, fanout: int = 8):
        first = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
        self.levels = [{"value": fps, "shared": np.full(len(fps), ALL), "end": np.arange(1, len(fps) + 1), "kids": None}]
        owner = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(fps)]))))
        low, high = fps, fps
        while len(owner) > len(first):
            start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            size = np.diff(np.concatenate((start, [len(owner)])))
            place = np.arange(len(owner)) - np.repeat(start, size)
            cut = np.flatnonzero(place % fanout == 0)
            low, high = np.bitwise_and.reduceat(low, cut), np.bitwise_or.reduceat(high, cut)
            below = self.levels[-1]
            bounds = np.concatenate((cut, [len(owner)]))
            self.levels.append({"value": low, "shared": ~(low ^ high), "end": below["end"][bounds[1:] - 1], "kids": bounds})
            owner = owner[cut]
        self.roots = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(fps)]))))
        self.fps = fps

    def later(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), j > i, of one bucket at no more than `distance` bits, for i in queries."""
        i, node = queries, self.roots[queries]
        top = self.levels[-1]
        far = np.bitwise_count((self.fps[i] ^ top["value"][node]) & top["shared"][node]).astype(np.int16)
        for level in range(len(self.levels) - 1, 0, -1):
            keep = (far <= distance) & (self.levels[level]["end"][node] > i + 1)
            i, node, far = i[keep], node[keep], far[keep]
            above, below = self.levels[level], self.levels[level - 1]
            n = above["kids"][node + 1] - above["kids"][node]
            child = np.repeat(above["kids"][node] - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n, n) + np.arange(n.sum())
            i, far, known = np.repeat(i, n), np.repeat(far, n), np.repeat(above["shared"][node], n)
            own = below["shared"][child] & ~known  # the bits that the parent does not share
            far = far + np.bitwise_count((self.fps[i] ^ below["value"][child]) & own).astype(np.int16)
            node = child
        keep = (far <= distance) & (node > i)
        return i[keep], node[keep]


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of many pairs at once; parents always point to smaller places."""
    while len(a):
        while (nxt := parent[parent]).tolist() != parent.tolist() if len(parent) < 64 else not np.array_equal(nxt := parent[parent], parent):
            parent[:] = nxt
        a, b = parent[a], parent[b]
        open_ = a != b
        a, b = np.minimum(a[open_], b[open_]), np.maximum(a[open_], b[open_])
        parent[b] = a


def forest(buckets: np.ndarray, fps: np.ndarray, distance: int, room: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fp, fp) that connect whatever is linked inside each bucket: less than one edge a row."""
    order = np.lexsort((gray_rank(fps), buckets))
    buckets, fps = buckets[order], fps[order]
    index, parent = GrayIndex(buckets, fps), np.arange(len(fps))
    largest = int(np.bincount(index.roots).max()) if len(fps) else 1
    step = max(16, room // largest)
    for at in range(0, len(fps), step):
        _unite(parent, *index.later(np.arange(at, min(at + step, len(fps))), distance))
    _unite(parent, parent, np.arange(len(parent)))
    moved = parent != np.arange(len(parent))
    return fps[moved], fps[parent[moved]]


def _blocks(distance: int, picked: int) -> list[int]:
    """Bit masks: `picked` of distance + picked even blocks; at most `distance` differing bits leave one mask untouched."""
    from itertools import combinations

    n = distance + picked
    cuts = [BITS * k // n for k in range(n + 1)]
    block = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(n)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(block[k] for k in c)) for c in combinations(range(n), picked)]


def links(fps: DataFrame, distance: int = 4, rows_a_bucket: int = 4096, rows_a_group: int = 2048) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly what lies within `distance` bits.

    fps: one column fp, distinct. The number of agreeing blocks that make a bucket key follows the count
    of fingerprints, so that an average bucket stays below rows_a_bucket. Buckets above that (many near
    copies) are cut by Gray order into chunks; chunks whose shared bits already differ too much are not
    paired, all other pairs of chunks are searched in tasks of their own.
    """
    total = fps.count()
    picked = next(p for p in (1, 2, 3, 4) if p == 4 or total >> int(BITS * p / (distance + p)) <= rows_a_bucket // 4)
    masks = _blocks(distance, picked)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("block", "mask")).select(
        "fp", "block", F.col("fp").bitwiseAND(F.col("mask")).alias("key")
    )
    keyed = materialise(keyed, "simhash-keys")
    sizes = materialise(keyed.groupBy("block", "key").count().where(F.col("count") > 1), "simhash-buckets")
    hot = sizes.where(F.col("count") > rows_a_bucket)
    small = keyed.join(sizes.where(F.col("count") <= rows_a_bucket), ["block", "key"])
    groups = max(1, total * len(masks) // rows_a_group)
    units = small.select("fp", F.xxhash64("block", "key").alias("bucket")).withColumn("unit", F.pmod("bucket", F.lit(groups)))
    schema = "a long, b long"

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy().view(np.uint64)
        a, b = forest(pdf["bucket"].to_numpy(), np.ascontiguousarray(fp), distance)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    found = units.groupBy("unit").applyInPandas(search, schema)
    if hot.isEmpty():
        return found
    gray = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        gray = gray.bitwiseXOR(F.shiftrightunsigned(gray, s))
    parts = max(8, hot.agg(F.sum("count")).first()[0] * 4 // rows_a_bucket)
    rows = keyed.join(hot.select("block", "key"), ["block", "key"]).withColumn("gray", gray)
    rows = rows.repartitionByRange(parts, "block", "key", "gray").sortWithinPartitions("block", "key", "gray")
    rows = materialise(rows.withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), (rows_a_bucket // 2).bit_length() - 1)), "simhash-hot")
    chunks = materialise(
        rows.groupBy("block", "key", "chunk").agg(F.expr("bit_and(fp)").alias("low"), F.expr("bit_or(fp)").alias("high")), "simhash-chunks"
    )
    one = chunks.select("block", "key", F.col("chunk").alias("c1"), F.col("low").alias("l1"), F.col("high").alias("h1"))
    two = chunks.select("block", "key", F.col("chunk").alias("c2"), F.col("low").alias("l2"), F.col("high").alias("h2"))
    shared = lambda low, high: F.bitwise_not(F.col(low).bitwiseXOR(F.col(high)))
    pairs = one.join(two, ["block", "key"]).where(F.col("c1") <= F.col("c2"))
    pairs = pairs.where(F.bit_count(F.col("l1").bitwiseXOR(F.col("l2")).bitwiseAND(shared("l1", "h1")).bitwiseAND(shared("l2", "h2"))) <= distance)
    pairs = pairs.select("block", "key", F.xxhash64("block", "key", "c1", "c2").alias("unit"), F.array_distinct(F.array("c1", "c2")).alias("chunk"))
    pairs = materialise(pairs.withColumn("chunk", F.explode("chunk")), "simhash-pairs")
    hot_units = rows.join(pairs, ["block", "key", "chunk"]).select("fp", "unit", F.col("unit").alias("bucket"))
    return found.unionByName(hot_units.groupBy("unit").applyInPandas(search, schema))


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, rows_a_bucket: int = 4096) -> DataFrame:
    """doc_id, fp (signed long), component_id for every row of docs.

    component_id is the smallest doc_id reachable over links of at most `distance` bits. A null or empty
    text has fingerprint zero and links like any other; null doc_ids keep their row and only name a
    component that has no other id; repeated rows are kept. Texts of one fingerprint are one node, so a
    large group of copies costs one row in the search.
    """
    return labelled(materialise(fingerprints(docs, words), "simhash-docs"), distance, rows_a_bucket).select("doc_id", "fp", "component_id")


def labelled(marked: DataFrame, distance: int, rows_a_bucket: int) -> DataFrame:
    """marked (doc_id, row_key, fp) with component (one of its fingerprints) and component_id."""
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    member = connected_components(links(nodes.select("fp"), distance, rows_a_bucket), "a", "b")
    joined = materialise(nodes.join(member.withColumnRenamed("node", "fp"), "fp").select("fp", "low", "component"), "simhash-members")
    lows = materialise(joined.groupBy("component").agg(F.min("low").alias("component_low")), "simhash-lows")
    found = joined.join(lows, "component").select("fp", "component", "component_low")
    labels = materialise(nodes.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.coalesce("component_low", "low").alias("component_id")), "simhash-labels")
    return marked.join(labels, "fp")


def keep_one(docs: DataFrame, words: int = 4, distance: int = 4, rows_a_bucket: int = 4096) -> DataFrame:
    """docs with one row of each near-duplicate group: of the smallest (doc_id, hash of id and text), the first of equal rows.

    Rows with one id and different texts are told apart. Null ids stay, all of them: they can't be named as copies.
    All columns are kept; an empty table gives no rows.
    """
    named = docs.where("doc_id is not null")
    groups = labelled(materialise(fingerprints(named, words), "simhash-docs"), distance, rows_a_bucket)
    first = groups.groupBy("component").agg(F.min(F.struct("doc_id", "row_key")).alias("first"))
    ident, key, n = fresh(docs, "ident", "key", "n")
    first = materialise(first.select(F.col("first.doc_id").alias(ident), F.col("first.row_key").alias(key)), "simhash-first")
    kept = named.withColumns({ident: F.col("doc_id").cast("long"), key: row_key()}).join(first, [ident, key], "left_semi")
    one = kept.withColumn(n, F.row_number().over(Window.partitionBy(ident, key).orderBy(F.lit(0)))).where(F.col(n) == 1)
    return one.select(*[F.col(quoted(c)) for c in docs.columns]).unionByName(docs.where("doc_id is null"))

"""Hard-negative mining: score bounds from angles to reference directions, integer scores only inside the windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenlake.sources.scratch import discard, materialise

#: Reference directions, and the rows (by a hash of the id) that they are chosen from.
DIRECTIONS, SAMPLE = 16, 2000
#: Largest number of rows and of anchors that meet in one task; with few rows, blocks are smaller but no more than SPREAD.
ROWS, ANCHORS, SPREAD, SMALL = 65_536, 8192, 64, 256
#: Stored angles are single precision: how far one may be off, in radians, with room to spare.
ANGLE_SLACK = 4e-6
LOWEST, HIGHEST = -(2**63) + 1, 2**63 - 1


def integers(v: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as doubles (exact: they are whole numbers)."""
    return F.transform(v, lambda x: _floor(x.cast("double") * scale))


def _floor(x: Column) -> Column:
    """floor() in doubles: Spark's own floor makes a long, too short for the largest components."""
    near = F.rint(x)
    return near - F.when(near > x, 1.0).otherwise(0.0)


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, q: rows with a label and a vector of finite components, as integers."""
    v = F.col("embedding")
    whole = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.where(F.col("label").isNotNull() & v.isNotNull()).where(whole).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), integers(v, scale).alias("q"))


def directions(rows: DataFrame, wanted: int = DIRECTIONS, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors far from each other, out of a bounded sample: each is the row of the widest angle to those before it."""
    held = [np.array(r["q"]) for r in rows.orderBy(F.xxhash64("vec_id", "q"), "vec_id").select("q").limit(sample).collect()]
    sizes = [len(h) for h in held]
    usual = max(set(sizes), key=sizes.count) if sizes else 0
    held = [h / np.linalg.norm(h) for h in held if len(h) == usual and h.any()]
    if not held:
        return np.zeros((0, usual))
    held = np.array(held)
    chosen, near = [0], held @ held[0]
    while len(chosen) < min(wanted, len(held)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, held @ held[chosen[-1]])
    return held[chosen]


def with_angles(rows: DataFrame, middles: np.ndarray) -> DataFrame:
    """rows with norm and angles to the directions (none for vectors of another length), and a number of their own, `row`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms, angles = [], []
            for q in batch.column("q"):
                v = q.values.to_numpy(zero_copy_only=False)
                norms.append(float(np.linalg.norm(v)))
                apt = len(v) == middles.shape[1]  # a zero vector is at a right angle to all
                angles.append(np.arccos(np.clip(middles @ v / (norms[-1] or 1.0), -1, 1)).astype(np.float32) if apt else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norms, pa.float64()), pa.array(angles, pa.list_(pa.float32()))], [*batch.schema.names, "norm", "angles"])

    made = rows.mapInArrow(run, "vec_id long, label long, q array<double>, norm double, angles array<float>")
    return materialise(made.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")


def score_bounds(norm: float, angles: np.ndarray, norms: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest inner product of a vector with others, by the triangle rule for angles; without angles, by the norms."""
    size = norm * norms
    spare = 1e-9 * size + 1e-6  # rounding of norms, cosines and products
    if not len(angles):
        return -size - spare, size + spare
    both = others + angles
    least = np.abs(others - angles).max(axis=1) - ANGLE_SLACK
    most = np.minimum(both, 2 * np.pi - both).min(axis=1) + ANGLE_SLACK
    return size * np.cos(np.minimum(most, np.pi)) - spare, size * np.cos(np.maximum(least, 0)) + spare


def products(a: np.ndarray, rows: np.ndarray) -> list[int] | np.ndarray:
    """Exact inner products of whole numbers held as doubles, kept within 64 bits."""
    if not rows.size or np.abs(a).max() * np.abs(rows).max() * len(a) < 2**53:
        return (rows @ a).astype(np.int64)
    exact = [sum(int(x) * int(y) for x, y in zip(a, r, strict=True)) for r in rows]
    return np.array([min(max(s, LOWEST), HIGHEST) for s in exact], dtype=np.int64)


FOUND = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _matrix(table: pa.Table, name: str, n: int) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def meet(anchors: pa.Table, rows: pa.Table, same: bool, k: int) -> pa.Table:
    """For every window (low, high) of every anchor the k best of a block's rows of the same label, or of others.

    All vectors have one length, so all or none have angles.
    """
    out: list[tuple] = []
    n = rows.num_rows
    if n and anchors.num_rows:
        label, row, norm = (rows.column(c).to_numpy() for c in ("label", "row", "norm"))
        ids = rows.column("vec_id").to_pylist()
        order = sorted(range(n), key=lambda i: (ids[i] is None, ids[i] or 0, row[i]))
        place = np.empty(n, dtype=np.int64)  # of each row among equal scores
        place[order] = np.arange(n)
        q, angles = _matrix(rows, "q", n), _matrix(rows, "angles", n)
        groups: dict[int, np.ndarray] = {}
        mine, theirs = _matrix(anchors, "q", anchors.num_rows), _matrix(anchors, "angles", anchors.num_rows)
        for i, a in enumerate(anchors.select(["row", "label", "norm", "windows"]).to_pylist()):
            if a["label"] not in groups:
                groups[a["label"]] = np.flatnonzero((label == a["label"]) == same)
            index = groups[a["label"]]
            low, high = score_bounds(a["norm"], theirs[i], norm[index], angles[index])
            needed = np.zeros(len(index), dtype=bool)
            for w in a["windows"]:
                may = (high >= w["low"]) & (low <= w["high"])
                sure = low[(low >= w["low"]) & (high <= w["high"]) & (row[index] != a["row"])]
                if len(sure) >= k:  # so many lie in the window for certain: rows below the k-th of them are not wanted
                    may &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
                needed |= may
            index = index[needed]
            index = index[row[index] != a["row"]]
            score = products(mine[i], q[index])
            for w in a["windows"]:
                inside = np.flatnonzero((score >= w["low"]) & (score <= w["high"]))
                if len(inside) > 4 * k:  # only what reaches the k-th best
                    inside = inside[score[inside] >= np.partition(score[inside], len(inside) - k)[len(inside) - k]]
                first = inside[np.lexsort((place[index[inside]], -score[inside]))[:k]]
                out += [(a["row"], w["window"], int(row[index[j]]), ids[index[j]], int(score[j])) for j in first.tolist()]
    columns = list(zip(*out, strict=True)) if out else [()] * len(FOUND)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)


def best_in_windows(anchors: DataFrame, rows: DataFrame, same: bool, k: int, blocks: int, parts: int) -> DataFrame:
    """anchor, window, row, vec_id, score, rank: the k best rows of each window, by score and then id.

    Anchors meet rows of their length in blocks, each pair of blocks in one task. Each anchor first meets one block
    alone; the k-th best score there is what the others have to reach, so that later blocks score and return little.
    """
    kind = "anchor long, window int, row long, vec_id long, score long"
    block, part = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    asked = anchors.withColumn("dim", F.size("q")).withColumn("part", part)
    dealt = rows.withColumn("dim", F.size("q")).withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = dealt.select(*[F.col(c).alias(c) for c in dealt.columns])  # a cogroup needs columns of its own on each side
    keys = ["dim", "part", "block"]

    def against(asked: DataFrame, where: Column) -> DataFrame:
        return asked.withColumn("block", where).groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(lambda a, b: meet(a, b, same, k), kind)

    first = against(asked, block).groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min("score").alias("reached")).where(F.col("n") >= k)
    first = first.groupBy(F.col("anchor").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("window", "reached"))).alias("reached"))
    raised = lambda w: w.withField("low", F.greatest(w["low"], F.coalesce(F.try_element_at(F.col("reached"), w["window"]), w["low"])))
    narrowed = asked.join(first, "row", "left").withColumn("windows", F.when(F.col("reached").isNull(), F.col("windows")).otherwise(F.transform("windows", raised))).drop("reached")
    narrowed = materialise(narrowed, "negatives-asked")
    found = against(narrowed, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    place = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"))
    made = materialise(found.withColumn("rank", place).where(F.col("rank") <= k), "negatives-best")
    discard(narrowed)
    return made


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, shift: int = 7, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of embeddings (vec_id, embedding, label).

    Rows without a label or vector, or with a null or non-finite component, take no part. Where vec_id is divisible by
    `shift` the label becomes (label + 1) % 10; components become floor(scale * x); a score is the integer inner product.
    Anchors are rows whose vec_id is divisible by `every`, positives their best other rows of the label, negatives for
    each positive the best rows of other labels with 50 * positive <= 100 * negative <= 95 * positive.

    Directions come from at most SAMPLE rows; every row has its angles to them and takes part, whatever they are: a row
    is left out of scoring only where its bounds lie outside all windows of the anchor, so the result is exact. Equal
    scores go by vec_id. Repeated rows are rows of their own (an anchor never meets itself, but its copies). A row
    without vec_id is no anchor, keeps its label and comes last among equal scores. Vectors of different lengths have
    no score with each other. Scores beyond 64 bits count as the last number that fits. Other columns are not looked at.
    """
    rows = usable(vectors, scale).withColumn("label", F.when(F.col("vec_id") % shift == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    rows = with_angles(rows, directions(rows))
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
    blocks = max(1, -(-n["n"] // ROWS), min(SPREAD, -(-n["n"] // SMALL)))
    parts = max(1, -(-n["anchors"] // ANCHORS))
    window = lambda low, high: F.struct(F.lit(0).alias("window"), F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high"))
    anchors = rows.where(F.col("vec_id") % every == 0)
    near = best_in_windows(anchors.withColumn("windows", F.array(window(LOWEST, HIGHEST))), rows, True, positives, blocks, parts)
    near = near.select("anchor", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    floored = lambda x, by: F.expr(f"({x} - pmod({x}, {by})) div {by}")
    half, most = -floored("(-positive_score)", 2), F.col("positive_score") + floored("(-positive_score)", 20)
    windows = near.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("window", half.alias("low"), most.alias("high"))).alias("windows"))
    hard = best_in_windows(anchors.join(windows, "row"), rows, False, negatives, blocks, parts)
    named = hard.join(near, ["anchor", "window"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

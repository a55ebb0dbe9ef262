"""Close vectors through a tree of pivots with triangle bounds: pairs of a whole table, and an index that grows batch by batch."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions.vectors import angles
from lumenlake.sources.scratch import materialise

#: Most leaves of a tree (the driver holds one vector a leaf), and rows that a leaf is planted for.
LEAVES, A_LEAF = 16_384, 512
#: Tops whose leaves a row looks at to find its own, and rings of a leaf: rows of like angle to the pivot are one cell.
TOPS, RINGS = 4, 12
#: Products in one piece of a task: 64 MB of single precision numbers.
PIECE = 1 << 24
SLACK = 1e-4


@dataclass
class Tree:
    """Pivots in two levels: `tops` are the first of the leaves, and every leaf hangs on its nearest top."""

    leaves: np.ndarray
    tops: np.ndarray
    top_of: np.ndarray

    @classmethod
    def of(cls, leaves: np.ndarray) -> Tree:
        tops = leaves[: int(np.ceil(np.sqrt(len(leaves))))]
        if not len(leaves):
            return cls(leaves, tops, np.zeros(0, dtype=int))
        used, top_of = np.unique(angles(leaves, tops)[0].argmin(axis=1), return_inverse=True)  # equal tops: one has the leaves
        return cls(leaves, tops[used], top_of)

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row its cell (leaf and ring; the nearest leaf under its TOPS nearest tops), the angle to the leaf and the length."""
        near, size = angles(rows, self.tops)
        first = np.argsort(near, axis=1, kind="stable")[:, :TOPS]
        leaf, angle = np.zeros(len(rows), dtype=np.int32), np.full(len(rows), np.inf)
        for t in np.unique(first):
            own, under = np.flatnonzero((first == t).any(axis=1)), np.flatnonzero(self.top_of == t)
            found = angles(rows[own], self.leaves[under])[0]
            best, least = under[found.argmin(axis=1)], found.min(axis=1)
            better = least < angle[own]
            leaf[own[better]], angle[own[better]] = best[better], least[better]
        return leaf * RINGS + np.minimum(angle / np.pi * RINGS, RINGS - 1).astype(np.int32), angle, size


@dataclass
class Cells:
    """What the rows of each cell are known by: their number, least and widest angle to the pivot, the greatest length."""

    n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    longest: np.ndarray

    @classmethod
    def of(cls, facts: list, leaves: int) -> Cells:
        """facts: rows (cell, n, low, high, longest), several a cell add up."""
        size = leaves * RINGS
        made = cls(np.zeros(size, dtype=np.int64), np.full(size, np.pi), np.zeros(size), np.zeros(size))
        for r in facts:
            made.n[r["cell"]] += r["n"]
        for name, pick in (("low", np.minimum), ("high", np.maximum), ("longest", np.maximum)):
            pick.at(getattr(made, name), [r["cell"] for r in facts], [r[name] for r in facts]) if facts else None
        return made

    def only(self, leaves: list[int]) -> Cells:
        return Cells(np.where(np.isin(np.arange(len(self.n)) // RINGS, leaves), self.n, 0), self.low, self.high, self.longest)

    def with_(self, more: Cells) -> Cells:
        return Cells(self.n + more.n, np.minimum(self.low, more.low), np.maximum(self.high, more.high), np.maximum(self.longest, more.longest))


def may_meet(tree: Tree, known: Cells, rows: np.ndarray, threshold: float) -> np.ndarray:
    """(rows, cells): where the angles allow an inner product of `threshold`. Leaves under a top that is too far are not looked at."""
    may = np.zeros((len(rows), len(known.n)), dtype=bool)
    if threshold <= 0:
        return may | (known.n > 0)
    to_tops, size = angles(rows, tree.tops)
    for t in range(len(tree.tops)):
        cells = np.flatnonzero((known.n > 0) & np.repeat(tree.top_of == t, RINGS))
        if not len(cells):
            continue
        under, leaf = np.unique(cells // RINGS, return_inverse=True)
        wide = angles(tree.leaves[under], tree.tops[t : t + 1])[0][leaf, 0] + known.high[cells]
        near = np.flatnonzero(_within(to_tops[:, t], -np.inf, wide.max(), size, known.longest[cells].max(), threshold))
        if len(near):
            to_leaves = angles(rows[near], tree.leaves[under])[0][:, leaf]
            may[np.ix_(near, cells)] = _within(to_leaves, known.low[cells], known.high[cells], size[near, None], known.longest[cells], threshold)
    return may


def _within(angle, low, high, size, longest, threshold: float):
    """Whether a row at this angle to a pivot may reach the threshold with one between low and high of it."""
    needed = threshold / np.maximum(size * longest, 1e-30)
    return (needed <= 1 + SLACK) & (np.maximum(angle - high, low - angle) <= np.arccos(np.minimum(needed, 1)) + SLACK)


def plant(rows: DataFrame, leaves: int) -> Tree:
    """A tree whose leaves are at most `leaves` rows (key, v), chosen by a hash."""
    held = [r["v"] for r in rows.orderBy(F.xxhash64("key"), "key").select("v").limit(leaves).collect()]
    return Tree.of(np.array(held, dtype=float))


def placed(rows: DataFrame, tree: Tree) -> DataFrame:
    """rows with cell, angle and size."""

    def run(v: pd.Series) -> pd.DataFrame:
        cell, angle, size = tree.place(np.stack(v.to_list()).astype(float))
        return pd.DataFrame({"cell": cell, "angle": angle, "size": size})

    kind = "cell int, angle double, size double"
    return rows.withColumn("at", F.pandas_udf(run, kind)("v")).select(*rows.columns, "at.*")


def _leaf() -> Column:
    return (F.col("cell") / RINGS).cast("int")


def facts_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.max("size").alias("longest"))


def dealt(tree: Tree, known: Cells, rows_a_block: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First block and number of blocks of each cell, and of all: cells of a top share a block until it is full, a large cell has several."""
    start, parts, block, room = np.zeros(len(known.n), dtype=np.int64), np.ones(len(known.n), dtype=np.int64), 0, rows_a_block
    for cell in np.argsort(np.repeat(tree.top_of, RINGS), kind="stable").tolist():
        n = int(known.n[cell])
        if n > room and room < rows_a_block:
            block, room = block + 1, rows_a_block
        start[cell] = block
        if n > rows_a_block:
            parts[cell] = -(-n // rows_a_block)
            block += int(parts[cell])
        else:
            room -= n
    return start, parts, block + 1


def _blocks_met(tree: Tree, known: Cells, threshold: float, start: np.ndarray, parts: np.ndarray):
    """A function of a column of vectors: the blocks that each of them meets."""
    held = np.flatnonzero(known.n)
    of_cell = np.repeat(held, parts[held])
    blocks = start[of_cell] + np.arange(len(of_cell)) - np.repeat(np.cumsum(parts[held]) - parts[held], parts[held])

    def run(v: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        for at in range(0, len(v), 256):
            may = may_meet(tree, known, np.stack(v.iloc[at : at + 256].to_list()).astype(float), threshold)
            out += [np.unique(blocks[m]).astype(np.int32) for m in may[:, of_cell]]
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<int>")


def _leaves_met(tree: Tree, known: Cells, threshold: float):
    """A function of a column of vectors: the leaves that each of them meets."""

    def run(v: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        for at in range(0, len(v), 256):
            may = may_meet(tree, known, np.stack(v.iloc[at : at + 256].to_list()).astype(float), threshold)
            out += [np.flatnonzero(m).astype(np.int32) for m in may.reshape(len(may), -1, RINGS).any(axis=2)]
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<int>")


def _own_block(start: np.ndarray, parts: np.ndarray) -> Column:
    first, n = (F.from_json(F.lit(json.dumps(x.tolist())), "array<int>")[F.col("cell")] for x in (start, parts))  # one literal each
    return (first + F.pmod(F.xxhash64("key"), n)).cast("int")


def products(a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a and of b and their inner product where it reaches the threshold, piece by piece."""
    step = max(1, PIECE // max(1, len(b)))
    a32, b32 = a.astype(np.float32), b.astype(np.float32)
    for low in range(0, len(a), step):
        i, j = np.nonzero(a32[low : low + step] @ b32.T >= threshold - SLACK)
        i += low
        s = np.einsum("ij,ij->i", a[i].astype(float), b[j].astype(float))
        keep = s >= threshold
        yield i[keep], j[keep], s[keep]


def blocks_for(rows: int, most: int = 8192, least: int = 512, spread: int = 16) -> int:
    """Rows a block: an even share of few rows, `most` of many."""
    return max(least, min(most, -(-rows // spread)))


def meetings(df: DataFrame, threshold: float, key: str = "id", vector: str = "vector", group: str | None = None, rows_a_block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (key, v, g, block, task) as they are shuffled for close_pairs, one for each block that a row meets, and the rows themselves."""
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"), F.col(group or key).alias("g"))
    total = rows.count()
    block = rows_a_block or blocks_for(total)
    tree = plant(rows, min(LEAVES, -(-total // min(A_LEAF, max(1, block // 4)))))
    if not len(tree.leaves):
        return rows.select("key", "v", "g", F.lit(0).alias("block"), F.struct(F.lit(0).alias("low"), F.lit(0).alias("high")).alias("task")), rows
    # written, so that a row keeps its leaf however its batch is cut when a task runs again
    rows = materialise(placed(rows, tree), "close-pairs")
    known = Cells.of(facts_of(rows).collect(), len(tree.leaves))
    start, parts, _ = dealt(tree, known, block)
    own = rows.withColumn("block", _own_block(start, parts))
    met = own.withColumn("other", F.explode(_blocks_met(tree, known, threshold, start, parts)("v")))
    return met.select("key", "v", "g", "block", F.struct(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).alias("task")), rows


def close_pairs(df: DataFrame, threshold: float, key: str = "id", vector: str = "vector", group: str | None = None, rows_a_block: int | None = None) -> DataFrame:
    """a, b, similarity: vectors with an inner product of at least `threshold`, a < b; rows of one group never pair.

    Rows hang on the leaves of a two-level tree of pivots (at most LEAVES rows, chosen by hash), in rings of like angle.
    A row meets a block only where its angle to some leaf and the angles of a ring there allow the threshold at the
    ring's greatest length; leaves under a top that is too far are not looked at. So no pair is lost, and each pair of blocks is one
    task that holds no more than two blocks. The driver holds the pivots and one row a ring. Rows that no angle tells
    apart still meet all blocks: n / rows_a_block copies of each.
    """
    rows, _ = meetings(df, threshold, key, vector, group, rows_a_block)

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        task, made = pdf["task"].iloc[0], []
        one, two = pdf[pdf["block"] == task["low"]], pdf[pdf["block"] == task["high"]]
        if len(one) and len(two):
            ka, kb, ga, gb = one["key"].to_numpy(), two["key"].to_numpy(), one["g"].to_numpy(), two["g"].to_numpy()
            for i, j, s in products(np.stack(one["v"].to_list()), np.stack(two["v"].to_list()), threshold):
                keep = (ka[i] != kb[j]) & (ga[i] != gb[j])
                if task["low"] == task["high"]:
                    keep &= ka[i] < kb[j]
                a, b = ka[i][keep], kb[j][keep]
                made.append(pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "similarity": s[keep]}))
        return pd.concat(made) if made else pd.DataFrame({"a": pdf["key"][:0], "b": pdf["key"][:0], "similarity": np.zeros(0)})

    kind = dict(df.dtypes)[key]
    return rows.groupBy("task").applyInPandas(multiply, f"a {kind}, b {kind}, similarity double")


def holding(i: np.ndarray, j: np.ndarray, s: np.ndarray, label: np.ndarray, parent: list[int], second: int) -> np.ndarray:
    """Pairs (by number) that hold rows and labels together as all pairs do: the most similar one of each row i and label of j,
    and of pairs without a label (-1) those that join two groups. parent: groups so far; row j is node second + j."""
    out = np.zeros(len(i), dtype=bool)
    order = np.lexsort((-s, label[j], i))
    order = order[label[j[order]] >= 0]
    if len(order):
        new = np.ones(len(order), dtype=bool)
        new[1:] = (i[order][1:] != i[order][:-1]) | (label[j[order]][1:] != label[j[order]][:-1])
        out[order[new]] = True
    free = np.flatnonzero(label[j] < 0)
    for k, a, b in zip(free.tolist(), i[free].tolist(), (second + j[free]).tolist(), strict=True):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[a], out[k] = b, True
    return np.flatnonzero(out)


# --- an index that grows -----------------------------------------------------------------------------


class StoredVectors:
    """Vectors in a folder, by leaf: each batch adds its rows, and reads only the leaves that its own rows may meet.

    Rows: key and g (strings), v, and the columns of `payload` (name -> type). Everything is written by batch number and
    replaced as a whole, and a batch sees only lower numbers, so a batch that runs again after a failure leaves the
    same tables. When the rows are four times as many as the tree was planted for, the next batch plants a larger one
    and writes all rows anew: over all batches, each row is written a bounded number of times.
    """

    def __init__(self, spark: SparkSession, root: str, payload: dict[str, str] | None = None, grow: int = 4):
        self.spark, self.root, self.payload, self.grow = spark, root, payload or {}, grow
        self.kind = ", ".join(["key string", "g string", "v array<float>", *[f"{c} {t}" for c, t in self.payload.items()]])

    def _write(self, df: DataFrame, name: str, number: int, by: str | None = None) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/{name}/batch_id={number}")

    def _read(self, name: str, schema: str, number: int) -> DataFrame:
        """What the batches before `number` wrote; nothing where none did."""
        path = f"{self.root}/{name}"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], f"{schema}, batch_id int")
        return self.spark.read.schema(f"{schema}, batch_id int").parquet(path).where(F.col("batch_id") < number)

    def open(self, batch: DataFrame, number: int) -> None:
        """Choose the tree for a batch: the newest one before it, or a new one."""
        trees = self._read("trees", "planted long", number).orderBy(F.col("batch_id").desc()).limit(1).collect()
        self.number = number
        if trees:
            self.tree_of = trees[0]["batch_id"]
            self.tree = self._tree(self.tree_of)
            self.known = self._known()
            total = int(self.known.n.sum())
            if total < self.grow * max(1, trees[0]["planted"]) or len(self.tree.leaves) >= LEAVES:
                return
            rows = self.rows()
        else:
            total, rows = 0, None
        fresh = rows.select("key", "v") if rows is not None else batch.select("key", "v")
        count = total or batch.count()
        if not count:
            self.tree_of, self.tree, self.known = None, Tree.of(np.zeros((0, 0))), Cells.of([], 0)
            return
        self.tree, self.tree_of = plant(fresh, min(LEAVES, -(-count // A_LEAF) + 15)), number
        pivots = [(k, [float(x) for x in v]) for k, v in enumerate(self.tree.leaves)]
        self._write(self.spark.createDataFrame(pivots, "leaf int, v array<double>").coalesce(1), f"pivots-{number}", -1)
        if rows is not None:
            moved = materialise(placed(rows.drop("leaf", "cell", "angle", "size", "batch_id"), self.tree), "index-moved")
            self._write(moved.withColumn("leaf", _leaf()), f"rows-{number}", -1, "leaf")
            self._write(facts_of(moved).coalesce(1), f"facts-{number}", -1)
        self._write(self.spark.createDataFrame([(count,)], "planted long").coalesce(1), "trees", number)
        self.known = self._known()

    def _tree(self, name: int) -> Tree:
        rows = self._read(f"pivots-{name}", "leaf int, v array<double>", self.number).orderBy("leaf").collect()
        return Tree.of(np.array([r["v"] for r in rows]))

    def _known(self) -> Cells:
        return Cells.of(self._read(f"facts-{self.tree_of}", "cell int, n long, low double, high double, longest double", self.number).collect(), len(self.tree.leaves))

    def rows(self, leaves: list[int] | None = None) -> DataFrame:
        """The stored rows, of some leaves alone: only their folders are read."""
        found = self._read(f"rows-{self.tree_of}", f"{self.kind}, cell int, angle double, size double, leaf int", self.number)
        return found if leaves is None else found.where(F.col("leaf").isin(leaves))

    def meet(self, batch: DataFrame, threshold: float, rows_a_block: int = 8192, label: str | None = None) -> DataFrame:
        """a, b, similarity, fresh and b's payload: rows b of the batch (fresh; a < b) or stored before with an inner product of at
        least `threshold` with a row a of the batch; rows of one g never pair. open() goes before.
        label: a payload column; then no more pairs of a task than hold its rows and labels together (see holding)."""
        kind = f"a string, b string, similarity double, fresh boolean, {', '.join(f'{c} {t}' for c, t in self.payload.items())}".rstrip(", ")
        if not len(self.tree.leaves):
            return self.spark.createDataFrame([], kind)
        self.placed = materialise(placed(batch.select("key", "g", "v", *self.payload), self.tree), "index-batch")
        own = Cells.of(facts_of(self.placed).collect(), len(self.tree.leaves))
        met = self.placed.select(F.explode(_leaves_met(self.tree, self.known, threshold)("v")).alias("leaf")).distinct()
        self.read = sorted(r["leaf"] for r in met.collect())  # no more than the tree has
        both = self.known.only(self.read).with_(own)
        start, parts, _ = dealt(self.tree, both, rows_a_block)
        asked = self.placed.select("key", "g", "v", F.explode(_blocks_met(self.tree, both, threshold, start, parts)("v")).alias("block"))
        columns = ["key", "g", "v", "cell", *self.payload]
        held = self.rows(self.read).select(*columns, F.lit(False).alias("fresh")).unionByName(self.placed.select(*columns, F.lit(True).alias("fresh")))
        held = held.withColumn("block", _own_block(start, parts)).drop("cell")
        parts_of_batch = max(1, -(-int(own.n.sum()) // rows_a_block))
        asked = asked.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts_of_batch)).cast("int"))
        held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts_of_batch - 1))))
        payload = list(self.payload)

        def multiply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            made = []
            if len(left) and len(right):
                ka, kb, ga, gb, new = left["key"].to_numpy(), right["key"].to_numpy(), left["g"].to_numpy(), right["g"].to_numpy(), right["fresh"].to_numpy()
                labels, parent = pd.factorize(right[label])[0] if label else None, list(range(len(left) + len(right)))
                for i, j, s in products(np.stack(left["v"].to_list()), np.stack(right["v"].to_list()), threshold):
                    keep = (ga[i] != gb[j]) & np.where(new[j], ka[i] < kb[j], ka[i] != kb[j])
                    i, j, s = i[keep], j[keep], s[keep]
                    if label:
                        keep = holding(i, j, s, labels, parent, len(left))
                        i, j, s = i[keep], j[keep], s[keep]
                    made.append(pd.DataFrame({"a": ka[i], "b": kb[j], "similarity": s, "fresh": new[j]} | {c: right[c].to_numpy()[j] for c in payload}))
            return pd.concat(made) if made else pd.DataFrame({c: pd.Series(dtype=object) for c in ["a", "b", "similarity", "fresh", *payload]})

        keys = ["block", "part"]
        return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(multiply, kind)

    def add(self, columns: dict[str, Column] | None = None, joined: DataFrame | None = None) -> None:
        """Store the batch that met last; joined: its rows with payload that is known only now (key and the payload columns)."""
        if not len(self.tree.leaves):
            return
        rows = self.placed if joined is None else self.placed.drop(*self.payload).join(joined.select("key", *self.payload), "key")
        self._write(rows.withColumn("leaf", _leaf()).repartition("leaf"), f"rows-{self.tree_of}", self.number, "leaf")
        self._write(facts_of(self.placed).coalesce(1), f"facts-{self.tree_of}", self.number)

"""Connected components over an edge table, as alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenlake.sources.scratch import discard, materialise

#: Edges that the catalogue's operators leave to one task.
FEW = 10_000


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct edges as a written table, and a digest of the set, taken while it is written."""
    seen = Observation()
    made = materialise(edges.distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "cc")
    return made, (seen.get["n"], seen.get["sum"])


def _star(pairs: DataFrame, edges: Column) -> tuple[DataFrame, tuple]:
    """Edges (a, b) made from every (node, other) and the smallest of node and its others, low.

    low is written first, so that the join sees two plain scans and adaptive execution can split the
    partitions of hub nodes.
    """
    low = materialise(pairs.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low")), "cc-low")
    made = _written(pairs.join(low, "node").select(F.explode(edges).alias("e")).select("e.*").where("a != b"))
    discard(low)
    return made


def _joined(edges: DataFrame) -> DataFrame:
    """(node, component) of a few edges (a, b), in one task."""
    kind = dict(edges.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for batch in batches:
            for x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = sorted((find(x), find(y)))
                root[high] = low  # the smaller one stays: a root is the smallest of its nodes
        nodes = list(root)
        at = pa.array(nodes), pa.array([find(x) for x in nodes])
        yield pa.RecordBatch.from_arrays([c.cast(edges_type) for c in at], ["node", "component"])

    edges_type = to_arrow_type(edges.schema["a"].dataType)
    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, few: int = 0) -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node reachable.

    Self-loops and repeated edges are allowed; edges with a null end are ignored. Nodes only need an
    order, so ids may be integers or strings. Settled when a large and a small star in a row change
    nothing. Raises if max_rounds do not suffice. few: once there are no more distinct edges than
    this, one task joins them, for a round costs several jobs whatever its size.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    given, state = _written(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    if state[0] <= few:
        return _joined(given)
    alone = given.where("a = b").select(F.col("a").alias("node"))
    now = given.where("a <> b")
    edge = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    larger = F.when(F.col("other") > F.col("node"), F.array(edge("other", "low")))
    smaller = F.array(edge("other", "low"), edge("node", "low"))
    quiet = 0
    for step in range(2 * max_rounds):
        down = now.select(F.col("a").alias("node"), F.col("b").alias("other"))
        up = now.select(F.col("b").alias("node"), F.col("a").alias("other"))
        made, found = _star(down, smaller) if step % 2 else _star(down.unionByName(up), larger)
        discard(now)
        quiet = quiet + 1 if found == state else 0
        now, state = made, found
        if 0 < state[0] <= few:
            return _joined(now.unionByName(alone.select(F.col("node").alias("a"), F.col("node").alias("b"))))
        if quiet == 2 or not state[0]:
            roots = now.select(F.col("b").alias("node")).unionByName(alone).distinct().join(now.select(F.col("a").alias("node")), "node", "left_anti")
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

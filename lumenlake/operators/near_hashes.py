"""Pairs of 64-bit hashes that differ in few bits, by bands whose number follows the number of hashes."""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.hashes import hex_of, whole
from lumenlake.sources.scratch import materialise

BITS = 64
#: A band's value that more hashes than this share is split by the bits outside the band.
HEAVY = 16_384


@dataclass(frozen=True)
class Bands:
    """Bands of bits (shift, width), and the bits that each side of a join flips in one: the two together are what a band may differ in."""

    bands: tuple[tuple[int, int], ...]
    build: int
    probe: int

    @classmethod
    def of(cls, n: int, distance: int, bits: int = BITS) -> Bands:
        """n bands: of `distance` differing bits one band has at most distance // n."""
        edges = [round(k * bits / n) for k in range(n + 1)]
        return cls(tuple((a, b - a) for a, b in zip(edges, edges[1:], strict=False)), distance // n // 2, distance // n - distance // n // 2)

    @property
    def entries(self) -> int:
        """Rows a hash on both sides of the join."""
        return sum(sum(comb(w, r) for r in range(side + 1)) for _, w in self.bands for side in (self.build, self.probe))

    @property
    def rate(self) -> float:
        """Share of unrelated hashes that a hash meets."""
        return sum(sum(comb(w, r) for r in range(self.build + self.probe + 1)) / 2**w for _, w in self.bands)


def plan(hashes: int, distance: int) -> Bands:
    """The bands with the least rows a hash: entries, and hashes met by chance. More hashes take fewer, wider bands."""
    every = [Bands.of(n, distance) for n in range(2, 9)]
    return min((b for b in every if b.entries <= 20_000), key=lambda b: b.entries + b.rate * hashes)


def masks(width: int, bits: int) -> list[int]:
    """All masks of at most `bits` set bits."""
    return [sum(1 << k for k in c) for r in range(bits + 1) for c in combinations(range(width), r)]


def _shift(name: str, x: Column, by: Column) -> Column:
    return F.call_function(name, x, by)


def _low(width: Column) -> Column:
    """A mask of the lowest `width` (below 64) bits."""
    return _shift("shiftleft", F.lit(1).cast("long"), width) - 1


def entries(rows: DataFrame, x: Column, bands: Bands, flips: int, names: tuple[str, str]) -> DataFrame:
    """rows, one for each band and each flip of at most `flips` of its bits: the number of the band and the value with the flip."""
    number, value = names
    parts = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(x, s).bitwiseAND(F.lit((1 << w) - 1)).alias("v"), F.lit((1 << w) - 1).cast("long").alias("most")) for k, (s, w) in enumerate(bands.bands)])
    flip = F.from_json(F.lit(json.dumps(masks(max(w for _, w in bands.bands), flips))), "array<bigint>")
    made = rows.withColumn("_b", F.explode(parts)).withColumn("_m", F.explode(flip)).where(F.col("_m") <= F.col("_b.most"))
    return made.withColumn(number, F.col("_b.k")).withColumn(value, F.col("_b.v").bitwiseXOR(F.col("_m"))).drop("_b", "_m")


def _rest(bands: Bands) -> Column:
    """The bits of x outside the band `band`, closed up."""
    at = F.from_json(F.lit(json.dumps([s for s, _ in bands.bands])), "array<int>")[F.col("band")]
    width = F.from_json(F.lit(json.dumps([w for _, w in bands.bands])), "array<int>")[F.col("band")]
    above = _shift("shiftrightunsigned", _shift("shiftrightunsigned", F.col("x"), at), width)
    return _shift("shiftleft", above, at).bitwiseOR(F.col("x").bitwiseAND(_low(at)))


def near_pairs(hashes: DataFrame, distance: int, shape: str | None = None, bands: Bands | None = None, heavy: int = HEAVY) -> DataFrame:
    """a, b, d (and shape_a, shape_b): distinct hashes (column h, 16 hex digits) at no more than `distance` bits, a < b.

    shape: a column of whole numbers; then rows are distinct (h, shape), only shapes that differ by at most one pair, and
    (a, shape_a) < (b, shape_b). Each side of the join flips a part of the bits that a band may differ in, so both
    send few rows; no pair is lost. Hashes of a band's value that very many share are told apart by three bands of their other
    bits. Of the rows that meet, those at a greater distance go at once; a pair that met several times comes once.
    """
    rows = hashes.select(whole(F.col("h")).alias("x"), *([F.col(shape).cast("int").alias("shape")] if shape else [F.lit(0).alias("shape")]))
    rows = materialise(rows, "near-hashes")  # both sides of the join and the counts read it
    n = rows.count()
    bands = bands or plan(n, distance)
    names = ("band", "value")
    build, probe = entries(rows, F.col("x"), bands, bands.build, names), entries(rows, F.col("x"), bands, bands.probe, names)
    if shape:
        build = build.withColumn("near", F.explode(F.array(F.col("shape") - 1, F.col("shape"), F.col("shape") + 1)))  # the side with fewer flips
        probe = probe.withColumn("near", F.col("shape"))
    else:
        build, probe = build.withColumn("near", F.lit(0)), probe.withColumn("near", F.lit(0))
    keys = ["band", "value", "near"]
    if n <= heavy:  # no value can be shared by more
        return _named(_met(build, probe, keys, distance), shape)
    many = materialise(build.groupBy(*keys).count().where(F.col("count") > heavy).select(*keys), "heavy-values")  # at most entries / heavy rows
    if many.isEmpty():
        return _named(_met(build, probe, keys, distance), shape)
    inner = Bands.of(3, distance, BITS - max(w for _, w in bands.bands))
    inner = Bands(tuple((s, w) for s, w in inner.bands[:-1]) + ((inner.bands[-1][0], BITS - min(w for _, w in bands.bands) - inner.bands[-1][0]),), inner.build, inner.probe)
    deep = ("inner", "part")
    light = _met(build.join(many, keys, "left_anti"), probe, keys, distance)
    hot = _met(entries(build.join(many, keys, "left_semi"), _rest(bands), inner, inner.build, deep), entries(probe.join(many, keys, "left_semi"), _rest(bands), inner, inner.probe, deep), [*keys, *deep], distance)
    return _named(light.unionByName(hot), shape)


def _named(met: DataFrame, shape: str | None) -> DataFrame:
    """Each pair once, its ends in the order of their hex digits."""
    out = met.distinct().select(hex_of(F.col("xa")).alias("a"), hex_of(F.col("xb")).alias("b"), "d", "shape_a", "shape_b")
    right = F.struct("a", "shape_a") < F.struct("b", "shape_b")
    pick = lambda x, y: F.when(right, F.col(x)).otherwise(F.col(y))
    out = out.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), "d", pick("shape_a", "shape_b").alias("shape_a"), pick("shape_b", "shape_a").alias("shape_b"))
    return out if shape else out.drop("shape_a", "shape_b")


def _met(build: DataFrame, probe: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """xa, xb, d, shape_a, shape_b of the rows that meet and are near. A pair meets in both directions; one of them stays.

    Both sides are sorted: planned sizes leave out what explode makes of a row, and a side sent whole would go through the driver.
    """
    one = probe.select(*keys, F.col("x").alias("xa"), F.col("shape").alias("shape_a"))
    two = build.select(*keys, F.col("x").alias("xb"), F.col("shape").alias("shape_b"))
    met = one.join(two.hint("merge"), keys).withColumn("d", F.bit_count(F.col("xa").bitwiseXOR(F.col("xb"))))
    return met.where((F.col("d") <= distance) & (F.struct("xa", "shape_a") < F.struct("xb", "shape_b"))).select("xa", "xb", "d", "shape_a", "shape_b")

"""Near hashes against all pairs, at every number of bands, with values that very many share."""

import random

import pytest
from pyspark.sql import functions as F

from lumenlake.operators.near_hashes import Bands, entries, near_pairs, plan


def hashes(n, seed, shared=False):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 4)]
    out = set()
    for b in base:
        for _ in range(4):
            x = b
            for k in rng.sample(range(64), rng.randint(0, 12)):
                x ^= 1 << k
            out.add((x & ~0xFFFF_0000_0000) if shared else x)  # 16 bits that are the same in all
    return sorted(out)


def brute(xs, distance):
    return {(f"{a:016x}", f"{b:016x}", (a ^ b).bit_count()) for k, a in enumerate(xs) for b in xs[k + 1 :] if (a ^ b).bit_count() <= distance}


@pytest.mark.parametrize("n, distance", [(2, 6), (3, 10), (4, 10), (6, 10), (8, 12), (None, 10)])
def test_no_pair_is_lost(spark, n, distance):
    xs = hashes(300, 1)
    df = spark.createDataFrame([(f"{x:016x}",) for x in xs], "h string")
    got = near_pairs(df, distance, bands=Bands.of(n, distance) if n else None)
    rows = [tuple(r) for r in got.select("a", "b", "d").collect()]
    assert set(rows) == brute(xs, distance) and len(rows) == len(set(rows)) > 50


@pytest.mark.parametrize("n", [3, 4])
def test_shared_values_are_split(spark, n):
    xs = hashes(240, 2, shared=True)
    df = spark.createDataFrame([(f"{x:016x}",) for x in xs], "h string")
    assert {tuple(r) for r in near_pairs(df, 10, bands=Bands.of(n, 10), heavy=20).select("a", "b", "d").collect()} == brute(xs, 10)


def test_shapes(spark):
    rng = random.Random(3)
    rows = sorted({(x, rng.randrange(6)) for x in hashes(120, 4) for _ in range(2)})
    df = spark.createDataFrame([(f"{x:016x}", s) for x, s in rows], "h string, shape int")
    got = sorted(tuple(r) for r in near_pairs(df, 10, "shape").select("a", "shape_a", "b", "shape_b", "d").collect())
    want = sorted((f"{a:016x}", s, f"{b:016x}", t, (a ^ b).bit_count()) for k, (a, s) in enumerate(rows) for b, t in rows[k + 1 :] if abs(s - t) <= 1 and (a ^ b).bit_count() <= 10)
    assert got == want


def test_rows_a_hash_grow_less_than_the_hashes(spark):
    """Entries and chance meetings of a hash: the number of bands follows the number of hashes."""
    cost = {n: (b := plan(n, 10)).entries + b.rate * n for n in (500, 5000, 50_000, 5_000_000, 500_000_000)}
    assert len(plan(500, 10).bands) > len(plan(50_000, 10).bands) > len(plan(500_000_000, 10).bands)
    assert cost[5000] < 2 * cost[500] + 100 and cost[5_000_000] < 0.003 * 5_000_000
    df = spark.createDataFrame([(k,) for k in hashes(200, 5) if k < 1 << 63], "x long")
    b = Bands.of(4, 10)
    assert entries(df, F.col("x"), b, b.build, ("n", "v")).count() + entries(df, F.col("x"), b, b.probe, ("n", "v")).count() == df.count() * b.entries


@pytest.mark.parametrize("shape", [None, "shape"])
def test_no_side_goes_through_the_driver(spark, shape):
    """A small table is many rows once its flips are there: the join that they meet in sends neither side whole."""
    df = spark.createDataFrame([(f"{x:016x}", k % 3) for k, x in enumerate(hashes(200, 6))], "h string, shape int")
    made = near_pairs(df, 10, shape)
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString() and made.count() > 50

"""Bursts against one pass over all shots in order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.operators.bursts import bursts
from lumenlake.sources import scratch


@pytest.mark.parametrize("seconds, ranges", [(10, 1), (10, 60), (40, 7)])
def test_bursts_over_many_ranges(spark, seconds, ranges):
    rng = np.random.default_rng(3)
    at = np.cumsum(rng.choice([2, 9, 10, 11, 41, 90_000], 400, p=[0.5, 0.2, 0.15, 0.1, 0.045, 0.005])) + 1_700_000_000
    shots = [(f"s{k:03d}", f"h{k if k % 50 else 0}", int(t), [1.0, 0.0] if rng.random() < 0.97 else [0.0, 1.0]) for k, t in enumerate(at)]
    df = spark.createDataFrame(shots, "id string, sha256 string, at long, vector array<double>").selectExpr("id", "sha256", "timestamp_seconds(at) taken", "vector")
    seen, runs, last = set(), {}, None
    for name, sha, t, v in shots:
        if sha in seen:
            continue
        seen.add(sha)
        joined = last and t - last[1] <= seconds and float(np.dot(v, last[2])) >= 0.8
        start = last[0] if joined else name
        runs.setdefault(start, []).append(name)
        last = (start, t, v)
    want = {(start, name) for start, names in runs.items() if len(names) > 1 for name in names}
    assert {tuple(r) for r in bursts(df, seconds, 0.8, ranges).select("burst", "id").collect()} == want


def test_one_second_over_several_tasks(spark):
    """All shots at one time: ranges are cut by id, and one run goes through all of them."""
    shots = spark.range(20_000).select(F.format_string("s%06d", "id").alias("id"), F.col("id").cast("string").alias("sha256"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("taken"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    made = bursts(shots, ranges=8)
    assert {tuple(r) for r in made.groupBy("burst").count().collect()} == {("s000000", 20_000)}
    scan = next(made.sparkSession.read.parquet(p) for p in scratch._HELD if "burst-scan" in p and made.sparkSession.read.parquet(p).count() > 20_000)
    sizes = [r["count"] for r in scan.where("first is null").groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * 20_000 / 8


def test_no_shots(spark):
    df = spark.createDataFrame([("a", "x", None, [1.0]), ("b", "y", 5, None)], "id string, sha256 string, at long, vector array<double>").selectExpr("id", "sha256", "timestamp_seconds(at) taken", "vector")
    assert bursts(df).collect() == []

"""Connected components of odd edge tables."""

import random

import pytest

from lumenlake.operators.graph import connected_components


@pytest.mark.parametrize("few", [0, 70, 10_000])
def test_chain_hub_loops_and_nulls(spark, few):
    chain = [(k, k + 1) for k in range(100, 160)]
    hub = [(900, k) for k in range(500, 560)] + [(500, 900), (500, 900)]
    edges = spark.createDataFrame([*chain, *hub, (7, 7), (100, 100), (None, 5), (6, None)], "a long, b long")
    got = sorted(map(tuple, connected_components(edges, few=few).collect()))
    assert got == sorted([(7, 7), (900, 500), *[(k, 100) for k in range(100, 161)], *[(k, 500) for k in range(500, 560)]])


@pytest.mark.parametrize("few", [0, 10])
def test_no_edges_and_loops_alone(spark, few):
    assert connected_components(spark.createDataFrame([], "a string, b string"), few=few).collect() == []
    assert list(map(tuple, connected_components(spark.createDataFrame([("x", "x")], "a string, b string"), few=few).collect())) == [("x", "x")]


def test_random_graphs_of_strings(spark):
    rng = random.Random(1)
    edges = spark.createDataFrame([(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(200)], "a string, b string")
    assert sorted(connected_components(edges, few=10_000).collect()) == sorted(connected_components(edges).collect())

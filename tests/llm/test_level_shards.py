"""Shards near each other in bytes, none empty, with one text on a third of the rows."""

import random
from collections import Counter
from itertools import accumulate

from lumenlake.llm import sharding


def test_level_cuts_hold_the_capacity_and_leave_no_shard_empty():
    rng = random.Random(3)
    for _ in range(500):
        sizes = [rng.choice([1, 2, 5, 30, 400]) for _ in range(rng.randrange(1, 40))]
        k = rng.randrange(1, 12)
        capacity, cuts = sharding.minimax_cuts(sizes, k)
        bounds = [0, *cuts, len(sizes)]
        loads = [sum(sizes[a:b]) for a, b in zip(bounds, bounds[1:])]
        assert len(loads) == min(k, len(sizes)) and all(a < b for a, b in zip(bounds, bounds[1:])) and max(loads) == capacity
        assert sharding.cuts_within(capacity - 1, list(accumulate(sizes)), k) is None


def test_an_atom_above_the_mean_empties_no_shard():
    capacity, cuts = sharding.minimax_cuts([100] * 50 + [1200] + [100] * 180, 24)
    assert capacity == 1200 and len(cuts) == 23


def test_a_third_of_the_rows_as_one_text(spark):
    rows = [(k, f"text number {k} " + "word " * (k % 7)) for k in range(2000)] + [(5000 + k, "one text " * 4) for k in range(1000)]
    made = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    loads, total = Counter(), sum(r["size"] for r in made)
    for r in made:
        loads[r["shard"]] += r["size"]
    hot = next(r["shard"] for r in made if r["doc_id"] >= 5000)
    assert len(made) == 3000 and sorted(loads) == list(range(24)) and len({r["shard"] for r in made if r["doc_id"] >= 5000}) == 1
    rest = [v for s, v in loads.items() if s != hot]
    assert max(rest) < 1.2 * total / 24 and max(rest) < 2.2 * min(rest)


def test_cuts_over_single_texts_are_exact(spark):
    """The driver sees single texts near the cuts alone, yet finds the capacity over all of them."""
    from hashlib import md5

    rng = random.Random(11)
    for k, (n, digits) in enumerate(((1, 1), (30, 1), (400, 1), (3000, 2))):
        texts = [f"{k} {j} " + "w" * rng.choice([1, 5, 20, 300, 3000]) for j in range(n)]
        rows = [(md5(t.encode()).hexdigest(), len(t)) for t in texts for _ in range(rng.choice([1, 1, 1, 4]))]
        groups = Counter()
        for h, size in rows:
            groups[h] += size
        order = sorted(groups)
        capacity, cuts = sharding.exact_cuts(spark.createDataFrame(rows, "md5 string, size long"), 7, digits)
        assert capacity == sharding.minimax_cuts([groups[h] for h in order], 7)[0]
        bounds = [0, *(sum(h < c for h in order) for c in cuts), len(order)]
        loads = [sum(groups[h] for h in order[a:b]) for a, b in zip(bounds, bounds[1:])]
        assert max(loads) <= capacity and min(loads) > 0 and len(loads) == min(7, len(order)), (loads, capacity)


def test_repeated_rows_without_ids_are_numbered(spark):
    rows = [(None, "same")] * 500 + [(None, None)] * 300 + [(k, f"text {k}") for k in range(100)]
    made = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 5).collect()
    slots = {}
    for r in made:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(made) == 900 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in made if r["text_crc32"] == 0}) == 1

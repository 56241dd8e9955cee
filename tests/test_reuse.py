"""Cache logs against a plain least-recently-used list."""

import random

import pytest
from pyspark.sql import functions as F

from inkstrata.operators import reuse


def plain(keys, capacity):
    held, out = [], []
    for k in keys:
        distance = len(held) - 1 - held.index(k) if k in held else None
        out.append((distance, distance is not None and distance < capacity, (distance is None or distance >= capacity) and len(held) >= capacity))
        if k in held:
            held.remove(k)
        held.append(k)
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 16), (2, 8), (3, 64)])
def test_log_against_a_plain_list(spark, monkeypatch, seed, block):
    """Frequent and rare keys, steps far apart, blocks of values of every size."""
    monkeypatch.setattr(reuse, "BLOCK", block)
    rng = random.Random(seed)
    keys = [rng.choice(("hot", "hot", f"k{rng.randrange(40)}", f"rare{rng.randrange(5000)}")) for _ in range(900)]
    steps = sorted(rng.sample(range(10**9), len(keys)))
    rows = list(zip(steps, keys, strict=True))
    rng.shuffle(rows)
    uses = spark.createDataFrame(rows, "step long, text string")
    for capacity in (1, 20):
        found = [(r["distance"], r["hit"], r["evicts"]) for r in reuse.cache_uses(uses, ["text"], capacity=capacity).orderBy("step").collect()]
        assert found == plain(keys, max(2, capacity))


def test_empty_log(spark):
    assert reuse.cache_uses(spark.createDataFrame([], "step long, text string"), ["text"]).count() == 0


def test_distances_are_counted_once_a_use(spark):
    """No table of a row per use and level is made and summed up again."""
    uses = spark.createDataFrame([(i, f"k{i * i % 7}") for i in range(50)], "step long, text string").withColumn("pos", F.col("step"))
    plan = reuse._smaller_before(reuse.with_previous(uses, ["text"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("FlatMapGroupsInPandas") == 2

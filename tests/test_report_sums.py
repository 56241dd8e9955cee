"""Durations that are added up in an order give one sum, however their rows are dealt."""

import random

from inkstrata.operators import traces


def test_sums_follow_the_order(spark):
    rng = random.Random(4)
    spent = [round(rng.uniform(0.01, 90), 2) for _ in range(4000)]
    rows = [(c, n, "FullPage", False, v) for c in range(8) for n, v in enumerate(spent[500 * c : 500 * c + 500])]
    wanted = {}
    for c, _, _, _, v in rows:
        wanted[c] = wanted.get(c, 0.0) + v
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "capture_id long, event_id long, profile string, preprocess boolean, spent double")
    for parts in (1, 3, 16):
        found = traces.recognition_times(df.repartition(parts), "event_id").collect()
        assert {r["capture_id"]: r["spent"] for r in found} == wanted
        assert {r["times"] for r in found} == {500}

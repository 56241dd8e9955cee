"""Last traces as stream state: late, repeated and idle ones, held against sorting all of them."""

import random
from datetime import datetime, timedelta

from inkstrata.streaming import rings

SCHEMA = "ring string, at timestamp, id long, body string"
START = datetime(2024, 1, 1)


def feed(spark, tmp_path, batches, **how):
    """Each batch is one file, one run of the stream over the same state."""
    given, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(given)
        stream = spark.readStream.schema(SCHEMA).parquet(given)
        if how.get("idle_ms") is not None:
            stream = stream.withWatermark("at", "0 seconds")
        rings.keep(stream, out, mark, **how).awaitTermination()
    return out


def expected(batches, most):
    best = {}
    for ring, at, i, body in {(r[0], r[1], r[2]): r for rows in batches for r in rows if r[1] and r[2] is not None}.values():
        best.setdefault(ring, []).append((at, i, body))
    return sorted(((ring, *r) for ring, rows in best.items() for r in sorted(rows, reverse=True)[:most]), key=repr)


def test_late_and_repeated_traces(spark, tmp_path):
    rng = random.Random(4)
    one = lambda: (rng.choice(("hot", "hot", "hot", "cold", None)), START + timedelta(seconds=rng.randrange(200)), 0, "x")
    rows = [(r, at, i, f"t{i}") for i, (r, at, _, _) in enumerate(one() for _ in range(300))]
    batches = [rows[:150], [*rows[100:220], ("hot", None, 1, "no time"), ("hot", START, None, "no id")], [("rare", START, 7, None)], rows[220:] + rows[:20]]
    out = feed(spark, tmp_path, batches, parts=3)
    found = sorted(((r["ring"], r["at"], r["id"], r["body"]) for r in rings.latest(spark, out).collect()), key=repr)
    assert found == expected(batches, 20)


def test_idle_rings_go(spark, tmp_path):
    day = timedelta(days=1)
    batches = [[("old", START, 1, "a"), ("new", START, 2, "b")], [("new", START + day, 3, "c")], [("new", START + 2 * day, 4, "d")]]
    out = feed(spark, tmp_path, batches, parts=1, idle_ms=3_600_000)
    assert {r["ring"] for r in rings.latest(spark, out).collect()} == {"new"}

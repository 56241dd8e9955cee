"""Ball-tree filtering against a comparison of every vector with every centroid."""

import hashlib
import math
import random

import numpy as np
import pytest

from inkstrata.llm import ball_tree


def plain(rows, clusters=16, rounds=3, dimensions=64, scale=64):
    """{(id, cluster, distance): how often}, inertia by cluster, and centroids, by Python's whole numbers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(min(max(scale * x, -ball_tree.LIMIT), ball_tree.LIMIT)) for x in v]))
    order = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), p) for i, p in kept)
    centroids = [p for _, p in order[:clusters]]
    far = lambda p, c: sum((x - y) ** 2 for x, y in zip(p, c, strict=True))
    nearest = lambda p: min(range(len(centroids)), key=lambda k: (far(p, centroids[k]), k))
    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, p in kept:
            own[nearest(p)].append(p)
        centroids = [[sum(col) // len(ps) for col in zip(*ps, strict=True)] if ps else c for c, ps in zip(centroids, own, strict=True)]
    return sorted(((-1 if i is None else i), nearest(p), far(p, centroids[nearest(p)])) for i, p in kept), centroids


def found(df):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"]) for r in df.collect())


def odd_rows(n=400, dimensions=64, seed=3):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dimensions)] for _ in range(6)]
    rows = [(i, [m + rng.gauss(0, 0.1) for m in rng.choice(middles)]) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # one vector many times
    rows += [(5, rows[5][1]), (None, rows[3][1])]  # a repeated row, a null id
    rows += [(2000, None), (2001, []), (2002, [0.0] * (dimensions - 1)), (2003, [float("nan")] + [0.0] * (dimensions - 1)), (2004, [None] + [0.0] * (dimensions - 1)), (2005, [float("-inf")] * dimensions), (2006, [0.0] * (dimensions + 1))]
    return rows


def table(spark, rows):
    # extra columns named as those of the result
    return spark.createDataFrame([(i, v, 9, "x", -1) for i, v in rows], "vec_id long, embedding array<double>, cluster int, inertia string, distance long")


def test_every_vector_against_all_centroids(spark):
    rows = odd_rows()
    wanted, centroids = plain(rows)
    out = ball_tree.cluster(table(spark, rows).repartition(3))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert found(out) == wanted
    for r in out.collect():
        assert r["inertia"] == sum(d for _, _, d in wanted)
        assert r["cluster_inertia"] == sum(d for _, c, d in wanted if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


def test_huge_components_saturate(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice((-1e30, 1e30, 0.0, 3.4e7 * rng.random())) for _ in range(4)]) for i in range(60)]
    wanted, _ = plain(rows, clusters=5, dimensions=4)
    assert found(ball_tree.cluster(table(spark, rows), dimensions=4, clusters=5)) == wanted


def test_few_or_no_vectors(spark):
    rows = [(i, [float(i), 0.0]) for i in range(3)]
    out = ball_tree.cluster(table(spark, rows), dimensions=2)
    assert found(out) == plain(rows, dimensions=2)[0] and {r["inertia"] for r in out.collect()} == {0}
    nothing = ball_tree.cluster(table(spark, rows).limit(0))
    assert nothing.columns == out.columns and nothing.count() == 0
    assert ball_tree.cluster(table(spark, [(1, None), (2, [1.0])])).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_decisions_on_grids_full_of_ties(seed):
    """Whole numbers of a small range: many vectors are as near to two centroids, many are equal."""
    rng = np.random.default_rng(seed)
    points = rng.integers(-3, 4, (int(rng.integers(1, 700)), int(rng.integers(1, 4))))
    centroids = rng.integers(-3, 4, (int(rng.integers(1, 9)), points.shape[1]))
    order, tree = ball_tree.build(points, leaf_rows=int(rng.integers(1, 30)))
    distance = ((points[:, None] - centroids[None]) ** 2).sum(2)
    owner, away = ball_tree.assignment(tree, centroids)
    assert (owner == distance.argmin(1)[order]).all() and (away == distance.min(1)[order]).all()
    count, total = ball_tree.sums(tree, centroids)
    for k in range(len(centroids)):
        own = points[distance.argmin(1) == k]
        assert count[k] == len(own) and (total[k] == own.sum(0)).all()


def test_whole_balls_are_decided_without_their_vectors():
    """Groups far apart: nothing but balls is looked at."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-5, 6, (300, 8)) + 1000 * k for k in range(4)])
    _, tree = ball_tree.build(points)
    whole, _, of_row = ball_tree.decide(tree, np.array([[1000 * k] * 8 for k in range(4)]))
    assert (of_row == -1).all() and len(whole) < 12

"""Centroid clustering by ball-tree filtering, in exact integers.

1. Vectors are checked and made whole numbers inside Spark; the first centroids
   are the vectors of smallest hash.
2. Each task builds metric trees over the vectors it reads, of at most
   ``TREE_ROWS`` each, and writes them: one row per tree.  A node is a ball
   around a whole-numbered pivot with its squared radius, the count and the sum
   of its vectors.
3. A round sends the centroids (a bounded table) down every tree, level by
   level.  By the triangle inequality a centroid is out for a whole ball if
   another one is surely nearer to all of it.  Where one centroid is left, the
   ball's count and sum go to it without a look at its vectors; a ball of equal
   vectors is decided at its pivot; else its parts follow, and in the leaves the
   exact distances decide (ties: the smaller number).
4. Tasks send counts and sums by centroid and component: the driver gets
   ``clusters * dimensions`` numbers a round, whatever the number of vectors.

Trees are independent, so hot spots (many equal vectors) are small balls of
radius zero in many tasks, and nothing is grouped before counts are folded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstrata.llm.common import materialise

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
#: Vectors of one tree (half a megabyte of 64 components), and of a leaf.
TREE_ROWS = 2048
LEAF_ROWS = 24
#: Whole numbers beyond this saturate: larger ones have no squared distance that a long holds.
LIMIT = 1 << 26
#: Up to this size products of components are exact in doubles.
EXACT_IN_DOUBLES = 1 << 22


@dataclass
class Tree:
    """Vectors in tree order, and nodes from the root down; children follow their parent."""

    points: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    level: np.ndarray
    parent: np.ndarray
    leaf: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray
    total: np.ndarray


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all rows of ``b`` (int64)."""
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if most <= EXACT_IN_DOUBLES:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]).astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


def build(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, Tree]:
    """The order of the vectors in the tree, and the tree: balls are cut between two members far apart."""
    order, nodes, stack = np.arange(len(points)), [], [(0, len(points), 0, -1)]
    while stack:
        start, stop, level, parent = stack.pop()
        own = order[start:stop]
        block = points[own]
        total = block.sum(0)
        pivot = total // len(own)
        away = ((block - pivot) ** 2).sum(1)
        radius, leaf = int(away.max()), True
        if len(own) > leaf_rows and radius:
            to_one = ((block - block[away.argmax()]) ** 2).sum(1)
            to_other = ((block - block[to_one.argmax()]) ** 2).sum(1)
            near = to_one <= to_other
            cut = int(near.sum())
            if 0 < cut < len(own):
                leaf = False
                order[start:stop] = np.concatenate([own[near], own[~near]])
                stack += [(start + cut, stop, level + 1, len(nodes)), (start, start + cut, level + 1, len(nodes))]
        nodes.append((start, stop, level, parent, leaf, pivot, radius, total))
    start, stop, level, parent, leaf, pivot, radius, total = (np.array(c) for c in zip(*nodes, strict=True))
    return order, Tree(points[order], start, stop, level, parent, leaf, pivot, radius, total)


def decide(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, centroid of each) decided as whole balls, and the centroid of every vector of undecided leaves (-1 for the others)."""
    n, k = len(tree.start), len(centroids)
    open_to = np.zeros((n, k), bool)
    owner, of_row = np.full(n, -1), np.full(len(tree.points), -1)
    nodes = np.zeros(1, np.int64)
    open_to[0] = True
    for level in range(int(tree.level.max()) + 1):
        if level:
            nodes = np.flatnonzero(tree.level == level)
            nodes = nodes[open_to[tree.parent[nodes]].any(1)]
            open_to[nodes] = open_to[tree.parent[nodes]]
        if not len(nodes):
            break
        distance = np.where(open_to[nodes], squared_distances(tree.pivot[nodes], centroids), np.iinfo(np.int64).max)
        radius = np.sqrt(tree.radius[nodes].astype(np.float64))
        reach = np.sqrt(distance.min(1).astype(np.float64)) + radius
        # a margin far above the rounding of the roots: a tie is never decided here
        left = open_to[nodes] & (np.sqrt(distance.astype(np.float64)) - radius[:, None] <= reach[:, None] * (1 + 1e-12) + 1e-6)
        done = (left.sum(1) == 1) | (tree.radius[nodes] == 0)
        owner[nodes[done]] = np.where(left[done], distance[done], np.iinfo(np.int64).max).argmin(1)
        open_to[nodes] = left & ~done[:, None]
        for at in np.flatnonzero(~done & tree.leaf[nodes]):
            node, some = nodes[at], np.flatnonzero(left[at])
            rows = slice(tree.start[node], tree.stop[node])
            of_row[rows] = some[squared_distances(tree.points[rows], centroids[some]).argmin(1)]
            open_to[node] = False
    whole = np.flatnonzero(owner >= 0)
    return whole, owner[whole], of_row


def sums(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and componentwise sum of the vectors of each centroid."""
    whole, owner, of_row = decide(tree, centroids)
    count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    np.add.at(count, owner, tree.stop[whole] - tree.start[whole])
    np.add.at(total, owner, tree.total[whole])
    rows = np.flatnonzero(of_row >= 0)
    np.add.at(count, of_row[rows], 1)
    np.add.at(total, of_row[rows], tree.points[rows])
    return count, total


def assignment(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroid and squared distance of every vector, in tree order."""
    whole, owner, of_row = decide(tree, centroids)
    for node, own in zip(whole, owner, strict=True):
        of_row[tree.start[node] : tree.stop[node]] = own
    return of_row, ((tree.points - centroids[of_row]) ** 2).sum(1)


# --- as Spark jobs -----------------------------------------------------------


def whole_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, point): vectors of ``dimensions`` finite components, each as ``floor(scale * x)``; beyond ``LIMIT`` they saturate."""
    fits = f"size({column}) = {dimensions} AND forall({column}, x -> x IS NOT NULL AND NOT isnan(CAST(x AS double)) AND abs(CAST(x AS double)) < double('Infinity'))"
    point = f"transform({column}, x -> CAST(floor(least({LIMIT}D, greatest(-{LIMIT}D, {scale}D * CAST(x AS double)))) AS bigint))"
    return vectors.where(F.expr(fits)).select(F.col(id_column).alias("vec_id"), F.expr(point).alias("point"))


def first_centroids(points: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The points of smallest hash of ``1:<id>`` (a null id is empty text; equal ids by their components); fewer if there are fewer."""
    hashed = points.select(F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("hash"), "point")
    rows = hashed.orderBy("hash", "point").limit(clusters).collect()
    return np.array([r["point"] for r in rows], np.int64)


_ARRAYS = ("start", "stop", "level", "parent", "leaf", "pivot", "radius", "total")


def trees_of(points: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """One row per tree: the ids of its vectors in tree order, and its arrays."""
    id_type = points.schema["vec_id"].dataType.simpleString()
    schema = f"ids array<{id_type}>, points binary, {', '.join(f'{a} binary' for a in _ARRAYS)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TREE_ROWS):
                part = batch.slice(at, TREE_ROWS)
                table = part.column("point").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
                order, tree = build(table)
                ids = part.column("vec_id").take(pa.array(order))
                cells = {"ids": pa.ListArray.from_arrays([0, len(ids)], ids), "points": pa.array([tree.points.astype(np.int32).tobytes()], pa.binary())}
                cells |= {a: pa.array([np.ascontiguousarray(getattr(tree, a)).astype(np.int64).tobytes()], pa.binary()) for a in _ARRAYS}
                yield pa.RecordBatch.from_pydict(cells)

    return points.mapInArrow(run, schema)


def _read(row: dict, dimensions: int) -> Tree:
    arrays = {a: np.frombuffer(row[a], np.int64) for a in _ARRAYS}
    arrays |= {a: arrays[a].reshape(-1, dimensions) for a in ("pivot", "total")} | {"leaf": arrays["leaf"].astype(bool)}
    return Tree(points=np.frombuffer(row["points"], np.int32).reshape(-1, dimensions).astype(np.int64), **arrays)


def over_trees(trees: DataFrame, schema: str, dimensions: int, use: Callable[[Tree, pa.Array], dict]) -> DataFrame:
    """``use`` of every tree and its ids, as columns of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in ("points", *_ARRAYS)}
                yield pa.RecordBatch.from_pydict(use(_read(row, dimensions), batch.column("ids")[at].values))

    return trees.mapInArrow(run, schema)


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of each one's vectors; those without any stay."""
    k, d = centroids.shape

    def use(tree: Tree, ids: pa.Array) -> dict:
        count, total = sums(tree, centroids)
        held = np.flatnonzero(count)
        cells = {"cluster": np.repeat(held, d).astype(np.int32), "component": np.tile(np.arange(d, dtype=np.int32), len(held)), "total": total[held].ravel(), "n": np.repeat(count[held], d)}
        return {c: pa.array(v) for c, v in cells.items()}

    parts = over_trees(trees, "cluster int, component int, total long, n long", d, use)
    out = centroids.copy()
    for r in parts.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        out[r["cluster"], r["component"]] = int(r["total"]) // r["n"]
    return out


def cluster(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that fits.

    Vectors that are null, of another length, or hold a null, NaN or infinity
    are not vectors and give no row; an empty table gives none.  Repeated rows
    each get their row, and as first centroids count as often as they occur; a
    null id stays null.  Fewer vectors than ``clusters`` make as many centroids
    as there are.  Components saturate at 2^26 after scaling.  Other columns are
    not read.  Inertia beyond a long is null.
    """
    points = whole_vectors(vectors, id_column, column, dimensions, scale)
    id_type = points.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(points, clusters)
    schema = f"vec_id {id_type}, cluster int, distance long"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = materialise(trees_of(points, dimensions), "balls")
    for _ in range(rounds):
        centroids = moved(trees, centroids)

    def use(tree: Tree, ids: pa.Array) -> dict:
        owner, distance = assignment(tree, centroids)
        return {"vec_id": ids, "cluster": pa.array(owner.astype(np.int32)), "distance": pa.array(distance)}

    assigned = materialise(over_trees(trees, schema, dimensions, use), "assigned")
    inertia = F.sum(F.col("distance").cast("decimal(38,0)"))
    by_cluster = {r["cluster"]: int(r["inertia"]) for r in assigned.groupBy("cluster").agg(inertia.alias("inertia")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(i, fits(by_cluster.get(i, 0)), fits(sum(by_cluster.values())), digest(c)) for i, c in enumerate(centroids)]
    # one row a centroid: as small as the list of centroids itself
    table = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(dimensions: int = DIMENSIONS, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same rows by comparing every vector with every centroid."""
    parts = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS p FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256(concat('1:', vec_id)), p) - 1 AS k, p FROM kept QUALIFY k < {clusters})",
    ]
    for i in range(rounds + 1):
        parts.append(f"far{i} AS (SELECT vec_id, v.p, k, list_sum(list_transform(range(1, {dimensions + 1}), lambda i: (v.p[i] - c.p[i]) * (v.p[i] - c.p[i])))::BIGINT AS d FROM kept v, c{i} c)")
        parts.append(f"near{i} AS (SELECT * FROM far{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)")
        if i < rounds:
            parts.append(f"mean{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j)::BIGINT[] AS p FROM (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(p) AS x, unnest(range({dimensions})) AS j FROM near{i}) GROUP BY k, j) GROUP BY k)")
            parts.append(f"c{i + 1} AS (SELECT k, coalesce(m.p, c.p) AS p FROM c{i} c LEFT JOIN mean{i} m USING (k))")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.p, ',')) AS centroid_sha256 FROM near{rounds} JOIN c{rounds} c USING (k)"""

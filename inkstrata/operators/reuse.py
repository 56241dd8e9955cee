"""What a least-recently-used cache would have held, from a log of uses: reuse distances as joins and windows.

A use finds its key in a cache of ``capacity`` entries if fewer than that many
other keys were used since its last use.  With positions from 0 and ``previous``
the position of a key's last use (-1 at its first), the distance of use ``i`` is

    (uses j < i with previous(j) < previous(i)) - previous(i) - 1

so it is a count of smaller values before a place.  Positions and values are
cut into blocks; inside a block a small tree counts for all its rows at once,
between blocks a table of counts does.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.sources.stages import stage

if TYPE_CHECKING:
    import pandas as pd

#: Positions, and values, of a block.
BLOCK = 1 << 16
#: Entries that a cache has, and the fewest it may have.
CAPACITY, LEAST = 512, 2


def positions(uses: DataFrame, step: str) -> DataFrame:
    """``uses`` with ``pos``, their place by ``step`` from 0: ranges are sorted apart and counted."""
    n = int(uses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the identifier is the range's number and the place in it; written, so that no later run can number anew
    ranged = stage(uses.repartitionByRange(n, step).sortWithinPartitions(step).withColumn("id", F.monotonically_increasing_id()), "ranges")
    rows = ranged.withColumns({"part": F.shiftright("id", 33), "at": F.col("id").bitwiseAND((1 << 33) - 1)})
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # one row a range: as many as there are shuffle partitions
    return rows.join(F.broadcast(before), "part").withColumn("pos", F.col("before") + F.col("at")).drop("id", "part", "at", "before")


def with_previous(uses: DataFrame, key: list[str]) -> DataFrame:
    """``uses`` with ``previous``, the position of the same key's last use; -1 at its first.

    Inside a block of positions by a window, between blocks by the last use of
    each block: a frequent key is one row a block there.
    """
    rows = uses.withColumn("block", F.shiftright("pos", 16))
    inside = F.lag("pos").over(Window.partitionBy(*key, "block").orderBy("pos"))
    ends = rows.groupBy(*key, "block").agg(F.max("pos").alias("last"))
    carried = ends.select(*key, "block", F.lag("last").over(Window.partitionBy(*key).orderBy("block")).alias("carried"))
    return rows.withColumn("inside", inside).join(carried, [*key, "block"]).withColumn("previous", F.coalesce("inside", "carried", F.lit(-1))).drop("inside", "carried", "block")


def counter(order: str, value: str, bits: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Adds to ``n``, for each row of a block, the rows before it by ``order`` with a smaller ``value``, shifted by ``bits``.

    A tree over the values: at each level a row in a right half counts the rows
    before it in the left half beside it, for all rows at once.
    """

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values(order, kind="stable")
        rank = np.unique(rows[value].to_numpy() >> bits, return_inverse=True)[1].astype("int64")
        found = np.zeros(len(rank), dtype="int64")
        for low in range(int(rank.max()).bit_length()):
            at = np.argsort(rank >> (low + 1), kind="stable")
            node, right = rank[at] >> (low + 1), (rank[at] >> low) & 1
            before = np.cumsum(1 - right)
            # what stood before a node begins is not its own
            first = np.flatnonzero(np.diff(node, prepend=-1))
            base = np.repeat(np.concatenate([[0], before[first[1:] - 1]]), np.diff(np.append(first, len(node))))
            found[at] += np.where(right == 1, before - base, 0)
        rows["n"] += found
        return rows[["pos", "previous", "n"]]

    return count


def _smaller_before(uses: DataFrame) -> DataFrame:
    """(pos, n): for each use that has a previous one, the uses before it with a smaller one, first uses not among them.

    A value is one use's only, so blocks of positions and blocks of values both
    hold a bounded number of rows: a block of positions counts what stands
    before in it, a block of values what stands in earlier blocks of positions.
    Earlier blocks of positions with smaller blocks of values count whole; their
    table has one row a pair of blocks.
    """
    bits = BLOCK.bit_length() - 1
    by = lambda c: F.shiftright(c, bits)
    schema = "pos long, previous long, n long"
    rows = uses.where("previous >= 0").select(F.col("pos").cast("long").alias("pos"), F.col("previous").cast("long").alias("previous"), F.lit(0).cast("long").alias("n"))
    near = rows.groupBy(by("pos").alias("block")).applyInPandas(counter("pos", "previous", 0), schema)
    near = near.groupBy(by("previous").alias("block")).applyInPandas(counter("previous", "pos", bits), schema)
    cells = rows.groupBy(by("pos").alias("at"), by("previous").alias("values")).agg(F.count("*").alias("c"))
    # all pairs of blocks, as uses of a pair without cells between count for later ones too
    last = cells.agg(F.max("at").alias("last"))
    grid = cells.groupBy("values").agg(F.min("at").alias("at")).crossJoin(F.broadcast(last)).select("values", F.explode(F.sequence("at", "last")).alias("at"))
    earlier = Window.partitionBy("values").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy("at").orderBy("values").rowsBetween(Window.unboundedPreceding, -1)
    past = grid.join(cells, ["at", "values"], "left").withColumn("past", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    whole = stage(past.withColumn("whole", F.coalesce(F.sum("past").over(smaller), F.lit(0))).where("c IS NOT NULL").select("at", "values", "whole"), "blocks")
    return near.withColumns({"at": by("pos"), "values": by("previous")}).join(whole, ["at", "values"]).select("pos", (F.col("n") + F.col("whole")).alias("n"))


def reuse(uses: DataFrame, key: list[str], step: str = "step") -> DataFrame:
    """``uses`` with ``distance`` (other keys since the last use; null at a key's first use) and ``known`` (different keys used before).

    ``step`` orders the log and is unique.  An empty log gives no rows.
    """
    rows = stage(with_previous(positions(uses, step), key), "uses")
    # first uses before each place: whole blocks of positions, and those inside one
    rows = rows.withColumns({"block": F.shiftright("pos", 16), "first": (F.col("previous") < 0).cast("long")})
    sums = rows.groupBy("block").agg(F.sum("first").alias("n"))
    before = sums.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("first").over(Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("inside", inside).join(before, "block").withColumn("known", F.col("before") + F.col("inside")).drop("before", "inside", "block", "first")
    counted = rows.join(_smaller_before(rows), "pos", "left")
    return counted.withColumn("distance", F.expr("CASE WHEN previous >= 0 THEN known + coalesce(n, 0) - previous - 1 END")).drop("n", "previous", "pos")


def cache_uses(uses: DataFrame, key: list[str], step: str = "step", capacity: int = CAPACITY) -> DataFrame:
    """``uses`` with ``distance``, ``hit``, and ``evicts``: whether its entry pushes another one out of a cache of ``capacity`` (2 at least) for all keys."""
    most = max(LEAST, capacity)
    rows = reuse(uses, key, step).withColumn("hit", F.coalesce(F.col("distance") < most, F.lit(False)))
    return rows.withColumn("evicts", ~F.col("hit") & (F.col("known") >= most)).drop("known")

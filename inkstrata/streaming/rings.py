"""The last traces of each ring, kept as stream state: what is bounded is the state, not a sort of all that ever came."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Traces that a ring holds, and the parts that its events are dealt to.
MOST, PARTS = 20, 16


def rings(traces: DataFrame, most: int = MOST, parts: int = PARTS, idle_ms: int | None = None) -> DataFrame:
    """(ring, part, kept) of every part of a ring that a batch changes: its last ``most`` traces, the last first.

    ``traces``: ring, at (a timestamp), id (long), body (string).  Traces are
    ordered by time, then id; one that comes late takes its place among those
    held or is let go, one that comes again counts once, and those without a
    time or an id are left out.  A ring's traces are dealt to ``parts`` by id, so
    a ring with a third of all events is no single task; ``latest`` puts the
    parts together.  With ``idle_ms`` (and a watermark on ``at``) the state of a
    part goes when no trace came for so long in event time, and its row says
    that nothing is kept.
    """
    held = traces.where("at IS NOT NULL AND id IS NOT NULL").withColumn("part", F.expr(f"CAST(pmod(xxhash64(id), {parts}) AS int)")).withColumn("micros", F.unix_micros("at"))

    def run(key: tuple[str, int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"kept": [[]]}).assign(ring=key[0], part=key[1])[["ring", "part", "kept"]]
            return
        found = {(at, i): body for at, i, body in zip(*state.get, strict=True)} if state.exists else {}
        for frame in frames:  # never more than the ring and one batch of Arrow at once
            found.update({(int(at), int(i)): body for at, i, body in zip(frame["micros"], frame["id"], frame["body"], strict=True)})
            found = {k: found[k] for k in sorted(found, reverse=True)[:most]}
        state.update(([k[0] for k in found], [k[1] for k in found], list(found.values())))
        if idle_ms is not None:
            newest = max((k[0] for k in found), default=0) // 1000
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        kept = [{"micros": at, "id": i, "body": body} for (at, i), body in found.items()]
        yield pd.DataFrame({"kept": [kept]}).assign(ring=key[0], part=key[1])[["ring", "part", "kept"]]

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.EventTimeTimeout
    return held.groupBy("ring", "part").applyInPandasWithState(run, "ring string, part int, kept array<struct<micros: bigint, id: bigint, body: string>>", "ats array<bigint>, ids array<bigint>, bodies array<string>", "update", timeout)


def keep(traces: DataFrame, folder: str, checkpoint: str, **how: int) -> StreamingQuery:
    """Run ``rings`` over what has come, each batch's changes to a folder of its own: a batch that runs again overwrites its own only."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rings(traces, **how).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str, most: int = MOST) -> DataFrame:
    """(ring, at, id, body): the last ``most`` of each ring, from the newest row of each of its parts.

    What is read grows with the rings, not with the events: ``most`` rows a part.
    """
    changes = spark.read.schema("ring string, part int, kept array<struct<micros: bigint, id: bigint, body: string>>, batch bigint").parquet(folder)
    newest = changes.groupBy("ring", "part").agg(F.max_by("kept", "batch").alias("kept"))
    rows = newest.select("ring", F.inline("kept"))
    nth = F.row_number().over(Window.partitionBy("ring").orderBy(F.desc("micros"), F.desc("id")))
    return rows.withColumn("nth", nth).where(F.col("nth") <= most).select("ring", F.timestamp_micros("micros").alias("at"), "id", "body")

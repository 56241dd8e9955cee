"""Captures as streams: segments per batch, and a translation cache kept as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkstrata.operators.segmentation import segments


def stream_segments(lines: DataFrame, write: Callable[[DataFrame, int], Any], checkpoint: str) -> StreamingQuery:
    """Each batch of whole captures is segmented and handed to ``write`` (which may run again for a batch: it should be idempotent)."""
    return lines.writeStream.foreachBatch(lambda batch, number: write(segments(batch), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cached(uses: DataFrame, capacity: int = 512) -> DataFrame:
    """(src, tgt, text, hit): whether each use finds its text among the ``capacity`` (2 at least) used last, of all language pairs.

    One cache is one state, so its uses pass through one task, batch by batch; a
    ``cache`` column, where ``uses`` has one, names several caches that run apart.
    Within a batch uses follow ``step``.  The state is a list of at most
    ``capacity`` keys, the least recent first.
    """
    most = max(2, capacity)
    rows = uses if "cache" in uses.columns else uses.withColumn("cache", F.lit("all"))
    columns = ["src", "tgt", "text"]

    def run(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict.fromkeys(map(tuple, state.get[0])) if state.exists else {}
        out = []
        for use in pd.concat(list(frames)).sort_values("step")[columns].itertuples(index=False, name=None):
            out.append((*use, use in held))
            held.pop(use, None)
            held[use] = None
            if len(held) > most:
                held.pop(next(iter(held)))
        state.update(([list(k) for k in held],))
        yield pd.DataFrame(out, columns=[*columns, "hit"])

    return rows.groupBy("cache").applyInPandasWithState(run, "src string, tgt string, text string, hit boolean", "entries array<array<string>>", "append", GroupStateTimeout.NoTimeout)

"""Bounded labelled samples for the two classifiers, and held-out flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstrata.llm.common import id_remainder, text_of

#: Labelled rows of each class that a fit may read.  The sample's size is the
#: only thing here that does not grow with the input.
ROWS_PER_CLASS = 6000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int = ROWS_PER_CLASS) -> tuple[DataFrame, float]:
    """(text, y) of at most ``rows_per_class`` training rows per class, and the share of class 1.

    Training rows are those whose crc32(doc_id as text) mod 3 is not 1.  Rows
    are picked by the hash of their id, so the pick does not follow any order
    in the data.  Repeated labels of an id count once (the largest), as do
    repeated texts (the least); null ids and null labels are left out.
    """
    train = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (id_remainder(3) != 1))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    counts = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    picks = None
    for y in (0, 1):
        part = train.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
        picks = part if picks is None else picks.unionByName(part)
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picks), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")
    total = sum(counts.values())
    return sample, (counts.get(1, 0) / total if total else 0.5)


def with_held_out(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, text."""
    return docs.select("doc_id", (id_remainder(3) == 1).alias("held_out"), text_of().alias("text"))

"""Stages: tables written once to the shared scratch folder and read by all that follow."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Tables that this driver has written, and what else to forget when they go.
_WRITTEN: list[str] = []
_FORGET: list[Callable[[], None]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a local one if driver and executors are one process, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/inkstrata-stages"
    return root.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the folder in ``spark.checkpoint.dir`` (a local one where that is unset, as in tests) and read back.

    Later steps read the table instead of repeating what made it, and a lost
    executor costs only its own tasks.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where a few files would keep most of them idle; a table of many files stays as it is.

    For rows that much work is about to be made of: a small input then costs one
    exchange of itself, a large one nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 4 * cores else df.repartition(2 * cores)


def drop_stages(spark: SparkSession) -> None:
    """Delete the stages of this driver; call it when no result that reads them is needed any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
    for forget in _FORGET:
        forget()


def with_stages(forget: Callable[[], None]) -> None:
    """Call ``forget`` whenever stages are deleted: for memos of tables that read them."""
    _FORGET.append(forget)

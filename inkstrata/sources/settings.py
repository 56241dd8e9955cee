"""Settings, and requests of one JSON object a line."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {"key": "", "region": "global", "endpoint": "https://api.cognitive.microsofttranslator.com"}


def parsed(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """``request``: the object in a text column; null where it is malformed. A byte order mark is dropped."""
    return rows.withColumn("request", F.from_json(F.regexp_replace(column, "^﻿", ""), schema))


def read_settings(spark: SparkSession, path: str) -> dict[str, str]:
    """Settings of a JSON file; defaults for what is missing, blank, or malformed."""
    try:
        found = spark.read.schema(", ".join(f"{k} string" for k in DEFAULTS)).json(path, multiLine=True).first()
    except Exception as e:  # an absent file is the usual case before the first run
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = None
    return {k: (found[k] if found and found[k] and found[k].strip() else v) for k, v in DEFAULTS.items()}


def write_settings(spark: SparkSession, path: str, values: dict[str, str]) -> None:
    """One JSON object; if all values are blank, what is there is deleted."""
    if not any(v.strip() for v in values.values()):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    else:
        spark.createDataFrame([tuple(values.get(k, "") for k in DEFAULTS)], ", ".join(f"{k} string" for k in DEFAULTS)).coalesce(1).write.mode("overwrite").json(path)


def provider(settings: dict[str, str], local_starts: bool, key_names: tuple[str, ...] = ("TRANSLATOR_KEY",)) -> str:
    """``service`` where a key is set or in one of the environment variables, else ``local`` if that translator starts, else ``demo``."""
    if settings.get("key", "").strip() or first_of(*key_names):
        return "service"
    return "local" if local_starts else "demo"


def first_of(*names: str) -> str:
    """The first environment variable that is not blank."""
    return next((v for n in names if (v := os.environ.get(n, "").strip())), "")

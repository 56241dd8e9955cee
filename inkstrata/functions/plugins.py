"""Plug points for models: recognition of pictures, run over Arrow batches with one model per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from inkstrata.sources.layout import LINE_TYPE

#: Makes a recogniser once per task: picture bytes, language, variant -> lines (text, box, words).
RecognizerFactory = Callable[[], Callable[[bytes, str, str], list[dict[str, Any]]]]


def recognize(pictures: DataFrame, factory: RecognizerFactory) -> DataFrame:
    """Lines of all (capture_id, content, language, variant) rows; a picture that fails gives no line, the others go on.

    Pictures come from ``spark.read.format("binaryFile")``; languages and image
    variants are rows, so they run in parallel.
    """
    schema = LINE_TYPE + ", language string, variant string"
    names = [f.name for f in _parse_datatype_string(schema).fields]
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                try:
                    found = model(r["content"], r["language"], r["variant"])
                except Exception:  # noqa: BLE001  a model may fail in its own ways on a broken picture
                    found = []
                out += [{"capture_id": r["capture_id"], "line_ord": i, "language": r["language"], "variant": r["variant"], **line} for i, line in enumerate(found)]
            yield pa.RecordBatch.from_pylist([{n: x.get(n) for n in names} for x in out], schema=arrow)

    return pictures.select("capture_id", "content", "language", "variant").mapInArrow(run, schema)


def text_stub() -> Callable[[bytes, str, str], list[dict[str, Any]]]:
    """A stand-in that reads the bytes as text, one line each, in even geometry."""

    def read(content: bytes, language: str, variant: str) -> list[dict[str, Any]]:
        return [{"text": t, "left": 0.0, "top": 20.0 * i, "width": 8.0 * len(t), "height": 16.0, "words": None} for i, t in enumerate(content.decode().split("\n")) if t.strip()]

    return read

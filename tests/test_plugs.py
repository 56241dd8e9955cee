import pandas as pd
from pyspark.sql import functions as F

from inkstrata.functions import plugins
from inkstrata.operators import pixels, styles, visual_split
from inkstrata.sources import layout
from inkstrata.streaming import captures


def test_recognition_plug(spark):
    pictures = spark.createDataFrame([(1, bytearray(b"File Path Size\nmore"), "en", "raw"), (2, bytearray(b"\xff\xfe"), "en", "raw")], "capture_id long, content binary, language string, variant string")
    out = plugins.recognize(pictures, plugins.text_stub).orderBy("capture_id", "line_ord").collect()
    assert [(r["capture_id"], r["text"], r["words"]) for r in out] == [(1, "File Path Size", None), (1, "more", None)]


def test_visual_split(spark):
    box = [(1, 0, i, x, 32.0, w, 18.0) for i, (x, w) in enumerate(((14.0, 54.0), (92.0, 38.0), (149.0, 34.0), (202.0, 66.0), (288.0, 62.0)))]
    schema = f"capture_id long, seg_ord int, text string, left double, top double, width double, height double, kind string, source_lines int, mode string, words array<{layout.WORD_TYPE}>"
    rows = [(1, 0, "Archives Types Parts Attributes Medialnfo", 10.0, 28.0, 350.0, 26.0, "TextLine", 1, "UiDense", None), (2, 0, "A paragraph stays as it is", 0.0, 0.0, 300.0, 20.0, "Paragraph", 1, "DocumentLike", None)]
    out = visual_split.split_by_boxes(spark.createDataFrame(rows, schema), spark.createDataFrame(box, "capture_id long, seg_ord long, box_ord int, left double, top double, width double, height double")).orderBy("capture_id", "part").collect()
    assert [(r["text"], r["kind"]) for r in out] == [*((t, "UiLabel") for t in ("Archives", "Types", "Parts", "Attributes", "Medialnfo")), ("A paragraph stays as it is", "Paragraph")]


def test_pixels(spark):
    rows = [(1, x, y, *((200, 0, 0) if x < 2 else (10, 10, 10))) for x in range(10) for y in range(4)]
    df = spark.createDataFrame(rows, "k int, x int, y int, r int, g int, b int").withColumn("bg", F.expr("named_struct('r', 10, 'g', 10, 'b', 10)"))
    ink = pixels.inks(df, "k").first()
    assert tuple(ink["color"]) == (200, 0, 0) and ink["ink"] == 0.2
    assert pixels.inks(df.where("x > 2"), "k").count() == 0
    assert tuple(pixels.backgrounds(df.where("x > 2"), "k").first()["bg"]) == (10, 10, 10)
    boxes = spark.createDataFrame([(1, 0, 0, 4, 3, 0, 0, 1, 3)], "k int, x0 int, y0 int, x1 int, y1 int, left int, top int, width int, height int")
    assert tuple(pixels.rings(df, boxes, "k").first()["bg"]) == (10, 10, 10)


def test_baseline(spark):
    rows = [(1, i, c, ink, h) for i, (c, ink, h) in enumerate((((10, 10, 10), 0.1, 10.0), ((12, 10, 10), 0.3, 11.0), ((250, 0, 0), 0.9, 30.0)))]
    out = styles.baselines(spark.createDataFrame(rows, "capture_id long, word_idx int, color struct<r: int, g: int, b: int>, ink double, height double")).first()
    assert (tuple(out["color"]), out["ink"], out["height"]) == ((11, 10, 10), 0.3, 11.0)


def test_streamed_segments(spark, tmp_path):
    lines = spark.createDataFrame([(1, 0, "File", 0.0, 0.0, 40.0, 16.0, None)], layout.LINE_TYPE)
    lines.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    query = captures.stream_segments(stream, lambda batch, n: batch.write.mode("overwrite").parquet(str(tmp_path / f"out-{n}")), str(tmp_path / "check"))
    query.awaitTermination(60)
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "out-0")).collect()] == ["File"]


def test_cache_state(spark, tmp_path):
    source = tmp_path / "uses"
    source.mkdir()
    schema = "step long, src string, tgt string, text string"
    # two language pairs share the two places of one cache
    for i, texts in enumerate((["one", "two", "one", "three"], ["one", "two", "three"])):
        pd.DataFrame([(10 * i + k, "en" if t != "two" else "de", "ru", t) for k, t in enumerate(texts)], columns=["step", "src", "tgt", "text"]).to_parquet(source / f"{i}.parquet")
    stream = captures.cached(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)), 2)
    query = stream.writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    hits = [(r["text"], r["hit"]) for r in spark.sql("SELECT * FROM hits").collect()]
    assert sorted(hits) == sorted([("one", False), ("two", False), ("one", True), ("three", False), ("one", True), ("two", False), ("three", False)])

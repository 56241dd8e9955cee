import random

from pyspark.sql import functions as F

import plain_folds as folds
from inkstrata.operators import fusion, modes, row_splits, segmentation
from inkstrata.sources import layout


def line(capture, order, box, words):
    """A line with words given as (text, left, top, width, height)."""
    return (capture, order, " ".join(w[0] for w in words), *map(float, box), [(w[0], *map(float, w[1:])) for w in words])


def row(top, height, *words):
    return [(t, left, top, width, height) for t, left, width in words]


TABS = row(10, 16, ("Archives", 10, 58), ("Types", 88, 38), ("Parts", 145, 36), ("Attributes", 201, 64), ("Medialnfo", 286, 60))
HEADER = row(40, 15, ("File", 12, 24), ("Path", 74, 28), ("Size", 142, 26))
FIRST = row(10, 18, ("This", 10, 24), ("paragraph", 40, 58), ("line", 104, 24), ("is", 134, 10), ("intentionally", 150, 74), ("long", 230, 30))
SECOND = row(31, 18, ("and", 11, 20), ("should", 38, 36), ("be", 80, 14), ("grouped", 100, 46), ("with", 152, 24), ("the", 182, 18), ("next", 206, 24), ("line", 236, 24))
LINES = [line(1, 0, (10, 10, 336, 16), TABS), line(2, 0, (12, 40, 170, 15), HEADER), line(3, 0, (10, 10, 250, 18), FIRST), line(3, 1, (11, 31, 249, 18), SECOND)]
LINES += [line(4, 0, (12, 10, 170, 15), row(10, 15, ("File", 12, 24), ("Path", 74, 28), ("Size", 142, 26))), line(4, 1, (10, 36, 210, 18), row(36, 18, ("This", 10, 24), ("paragraph", 40, 58), ("should", 104, 36), ("remain", 146, 40), ("separate", 192, 28)))]


def segments(spark, rows):
    df = segmentation.segments(spark.createDataFrame(rows, layout.LINE_TYPE))
    out = {}
    for r in df.orderBy("capture_id", "seg_ord").collect():
        out.setdefault(r["capture_id"], []).append((r["kind"], r["text"], r["source_lines"]))
    return out


def test_segmentation_cases_together_and_shuffled(spark):
    expected = {
        1: [("UiLabel", x, 1) for x in ("Archives", "Types", "Parts", "Attributes", "MediaInfo")],
        2: [("UiLabel", x, 1) for x in ("File", "Path", "Size")],
        3: [("Paragraph", "This paragraph line is intentionally long and should be grouped with the next line", 2)],
        4: [*(("UiLabel", x, 1) for x in ("File", "Path", "Size")), ("Paragraph", "This paragraph should remain separate", 1)],
    }
    assert segments(spark, LINES) == expected
    mixed = LINES[:]
    random.Random(3).shuffle(mixed)
    assert segments(spark, mixed) == expected
    assert segments(spark, LINES[:1]) == {1: expected[1]}


def test_empty_captures(spark):
    assert segmentation.segments(spark.createDataFrame([], layout.LINE_TYPE)).count() == 0
    assert segments(spark, [(9, 0, " ", 0.0, 0.0, 5.0, 5.0, None)]) == {}


def test_null_words_are_not_empty_words():
    assert folds.count_words({"text": "a b", "words": None}) == 2
    assert folds.count_words({"text": "a b", "words": []}) == 0


def test_structured_row_needs_no_lexicon(spark):
    words = row(0, 16, ("Alpha", 0, 40), ("Beta", 44, 32), ("Gamma", 130, 44), ("Delta", 240, 40))
    measured = row_splits.with_word_measures(spark.createDataFrame([line(1, 0, (0, 0, 280, 16), words)], layout.LINE_TYPE))
    parts = row_splits.lines_from(row_splits.structured_row(measured)).orderBy("part").collect()
    assert [r["text"] for r in parts] == ["Alpha Beta", "Gamma", "Delta"]


def test_sparse_row_and_boxes(spark):
    words = row(0, 16, ("one", 0, 30), ("two", 36, 30), ("three", 200, 40))
    measured = row_splits.with_word_measures(spark.createDataFrame([line(1, 0, (0, 0, 240, 16), words)], layout.LINE_TYPE))
    assert [r["text"] for r in row_splits.lines_from(row_splits.sparse_row(measured)).orderBy("part").collect()] == ["one two", "three"]
    assert row_splits.lines_from(row_splits.label_boxes(measured)).count() == 2


BOX = "capture_id long, seg_ord int, text string, left double, top double, width double, height double, kind string"


def boxes(spark, rows):
    return spark.createDataFrame([(c, o, t, *map(float, b), k) for c, o, t, b, k in rows], BOX)


def test_modes(spark):
    rows = [(1, 0, "A long paragraph of text here.", (10, 10, 260, 22), "Paragraph"), (1, 1, "and one more line of it", (12, 36, 258, 22), "TextLine")]
    rows += [(2, i, t, (10 + 70 * i, 10, 58, 16), "UiLabel") for i, t in enumerate(("Archives", "Types", "Parts", "Attributes", "MediaInfo"))]
    rows += [(3, 0, "Save", (10, 10, 34, 16), "UiLabel"), (3, 1, "This text describes the current status", (12, 44, 280, 22), "TextLine"), (3, 2, "and continues on a second line below", (12, 72, 286, 22), "TextLine")]
    found = {r["capture_id"]: r["mode"] for r in modes.capture_modes(boxes(spark, rows)).collect()}
    assert found == {1: "DocumentLike", 2: "UiDense", 3: "Mixed"}
    dense = {(r["capture_id"], r["seg_ord"]): r["others"] for r in modes.dense_neighbours(boxes(spark, rows)).collect()}
    assert dense[2, 0] == 4 and dense[3, 0] == 0


def test_policy(spark):
    rows = [(1, i, f"Label {i}", (10 + 80 * (i % 4), 10 + 30 * (i // 4), 60, 16), "UiLabel") for i in range(8)]
    rows += [(2, i, f"Label {i}", (10 + 80 * (i % 5), 10 + 30 * (i // 5), 60, 16), "UiLabel") for i in range(25)]
    found = {r["capture_id"]: (r["use"], r["visual_rows"], r["most_in_row"]) for r in modes.automation_policy(boxes(spark, rows)).collect()}
    assert found == {1: (True, 2, 4), 2: (False, 5, 5)}


def test_fusion(spark):
    primary = [(1, 0, "Archives Types Parts Attributes Medialnfo", (10, 10, 336, 16), "TextLine"), (2, 0, "A paragraph of running text goes on", (10, 40, 320, 20), "Paragraph"), (3, 0, "Camo Studio", (12, 8, 120, 18), "TextLine"), (3, 1, "Some longer text of a paragraph", (12, 36, 280, 20), "Paragraph")]
    automation = [(1, i, t, (x, 10, w, 16), "UiLabel") for i, (t, x, w) in enumerate((("Archives", 10, 58), ("Types", 88, 38), ("Parts", 145, 36), ("Attributes", 201, 64), ("MediaInfo", 286, 60)))]
    automation += [(2, 0, "File", (12, 10, 24, 15), "UiLabel"), (2, 1, "Path", (74, 10, 28, 15), "UiLabel"), (3, 0, "This PC", (320, 8, 48, 18), "UiLabel"), (3, 1, "Downloads", (320, 32, 64, 18), "UiLabel"), (3, 2, "OpenCvSharp.dll", (320, 56, 92, 18), "UiLabel")]
    found = {}
    for r in fusion.fuse(boxes(spark, primary), boxes(spark, automation)).collect():
        found.setdefault(r["capture_id"], []).append((r["kind"], r["text"]))
    assert sorted(found[1]) == sorted(("UiLabel", t) for t in ("Archives", "Types", "Parts", "Attributes", "MediaInfo"))
    assert [k for k, _ in found[2]] == ["Paragraph"]
    assert len(found[3]) == 2


def test_touching_boxes_do_not_meet(spark):
    a = boxes(spark, [(1, 0, "a", (0, 0, 10, 10), "TextLine")])
    assert fusion.related_pairs(a, boxes(spark, [(1, 0, "b", (10, 0, 10, 10), "UiLabel")])).count() == 0
    assert fusion.related_pairs(a, boxes(spark, [(1, 0, "b", (9, 0, 10, 10), "UiLabel")])).count() == 1


def test_covered_boxes_go(spark):
    rows = [(1, 0, "Open", (0, 0, 40, 10), "UiLabel"), (1, 1, "open ", (1, 0, 42, 10), "UiLabel"), (1, 2, "Close", (0, 0, 40, 10), "UiLabel")]
    kept = fusion.drop_covered(boxes(spark, rows).drop("kind")).collect()
    assert sorted(r["seg_ord"] for r in kept) == [0, 2]


def test_merged_responses_keep_the_better_line(spark):
    schema = "capture_id long, rank int, line_ord long, text string, left double, top double, width double, height double"
    rows = [(1, 0, 0, "hel@o", 0.0, 0.0, 50.0, 10.0), (1, 1, 0, "hello", 1.0, 0.0, 50.0, 10.0), (1, 1, 1, "new", 0.0, 40.0, 30.0, 10.0)]
    assert [r["text"] for r in fusion.merge_responses(spark.createDataFrame(rows, schema)).orderBy("top").collect()] == ["hello", "new"]


def test_geometry_of_documents_needs_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "a b c d\n\ne"), (2, None), (None, "x")], "doc_id long, text string")
    plan = layout.lines_of(docs)._jdf.queryExecution().toString()
    assert "Exchange" not in plan
    assert [(r["line_ord"], r["text"]) for r in layout.lines_of(docs).orderBy("line_ord").collect()] == [(0, "a b c d"), (200000, "e")]


def test_merge_boxes():
    at = lambda i, x, w: {"box_ord": i, "left": float(x), "top": 0.0, "width": float(w), "height": 10.0}
    assert [b["width"] for b in folds.merge_boxes([at(0, 0, 10), at(1, 14, 10), at(2, 60, 5)], 5)] == [24.0, 5.0]


def test_median(spark):
    assert spark.range(1).select(F.expr(row_splits.median_of("array(1D, 2D, 3D, 10D, -4D)")).alias("m"), F.expr(row_splits.median_of("array(-1D)")).alias("z")).first() == (2.5, 0.0)

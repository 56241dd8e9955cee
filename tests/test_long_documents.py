"""Documents of very many lines, and with a very long line, pass through the layout queries."""

import pytest

from inkstrata.plans import registry
from inkstrata.sources import layout

LINES = 30_000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("long"))
    many = "\n".join(f"Line {i} of a long text" if i % 3 else "Save File" for i in range(LINES))
    rows = [(1, many, "en", "s", len(many)), (2, None, "en", "s", 0), (3, "", None, None, 0), (None, "no id", "en", "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["related_boxes", "fused_rows", "uncovered_elements", "paragraph_blocks", "refinement_gates", "layout_segments", "dense_neighbours", "merged_responses", "visual_splits", "overlay_boxes"])
def test_many_lines(spark, folder, name):
    out = registry.QUERIES[name](spark, folder)
    top = out.selectExpr("count(*) AS n", "count(DISTINCT capture_id) AS captures").first()
    assert top["n"] > 0 and top["captures"] == 1


def test_ordinals_pass_the_range_of_an_int(spark, folder):
    assert registry.QUERIES["paragraph_blocks"](spark, folder).count() == registry.lines(spark, folder).count() >= LINES
    assert registry.lines(spark, folder).selectExpr("max(line_ord)").first()[0] > 2**31 - 1


def test_a_very_long_line(spark):
    """700,001 words: a line has room for 100,000 rows, so it counts as two or three; no ordinal is used twice."""
    words = 700_001
    docs = spark.createDataFrame([(8, "w " * words + "\nnext line"), (9, "short\n\nlast")], "doc_id long, text string")
    lines = layout.lines_of(docs)
    seen = lines.where("capture_id = 8").selectExpr("count(*) AS n", "count(DISTINCT line_ord) AS ordinals", "sum(size(words)) AS words", "max_by(text, line_ord) AS last").first()
    assert seen["n"] == seen["ordinals"] and seen["words"] == words + 2 and seen["last"] == "next line"
    assert [(r["line_ord"], r["text"]) for r in lines.where("capture_id = 9").orderBy("line_ord").collect()] == [(0, "short"), (200000, "last")]

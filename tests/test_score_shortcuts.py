"""Scores look twice only at texts and tokens that need it, and are the same."""

from __future__ import annotations

from inkstrata.functions import text as T
from inkstrata.functions.dialect import SPARK


def test_shortcuts_change_no_score(spark):
    texts = ["plain words here.", "mixеd scripts", "кот cat", "ab12 a1b2c", "...", "a..b c,d", "日本 abc", "日本x", "(abc)", "1234", "abc,\n", "x", "", " ", None, "naïve-fact", "漢字かな", "@@ �", "İstanbul", "éa"]
    letters, digits, marks = (SPARK.count("t", c) for c in (r"\p{L}", r"\p{Nd}", r"\p{P}"))
    broken = f"(length(t) > 2 AND ({letters} = 0 OR ({digits} >= 2 AND {letters} >= 2) OR {marks} >= 2))"
    tokens = lambda test: f"size(filter({SPARK.split('x')}, t -> {test}))"
    plain = f"(3 * {SPARK.count('x', T.WORD)} - 12 * {SPARK.count('x', T.SUSPICIOUS)} - 24 * {tokens(T.mixed_scripts('t'))} - 18 * {tokens(broken)})"
    rows = spark.createDataFrame([(t,) for t in texts], "x string").selectExpr("x", f"{T.line_score('x')} AS found", f"{plain} AS plain")
    assert rows.where("NOT found <=> plain").count() == 0 and rows.where("plain < 0").count() > 2


def test_a_response_is_normalised_once():
    assert T.response_score("x", "1", "'en'").count(T.normalize("x")) == 1

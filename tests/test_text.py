from pyspark.sql import functions as F

import plain_folds as folds
from inkstrata.functions import text as T
from inkstrata.functions.labels import compose, parse_label


def values(spark, rows, expression):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], "i int, x string" + (", y string" if isinstance(rows[0], tuple) else ""))
    return [r["v"] for r in df.orderBy("i").select(F.expr(expression).alias("v")).collect()]


def test_normalize_takes_any_white_space(spark):
    assert values(spark, ["  a  b\n\tc ", None, "\x0b\x85"], T.normalize("x")) == ["a b c", "", ""]


def test_language_by_script(spark):
    rows = ["Привет мир", "こんにちは", "漢字", "漢", "hello", "12 3", "Grüße", "abвг", "_^"]
    assert values(spark, rows, T.guess_language("x")) == ["ru", "ja", "zh-Hans", None, "en", None, "en", "ru", "en"]


def test_scores(spark):
    # mixed scripts cost 24, a broken token 18, a suspicious character 12
    assert values(spark, ["abc", "abв", "a1b2", "@ab", "", "..."], T.line_score("x")) == [9, 9 - 24, 12 - 18, 6 - 12, 0, -18]
    assert values(spark, ["", "ab"], T.response_score("x", "1", "'en'")) == [None, 6 + 10 + 40]


def test_kinds_and_headers(spark):
    assert values(spark, ["a b c d e f", "short text", "Hm!", "x" * 30], T.standalone_kind("x")) == ["Paragraph", "TextLine", "Paragraph", "Paragraph"]
    assert values(spark, ["File", "file", "7", "x", "aBC", "ABC", ""], T.header_word("x")) == [True, False, True, False, True, True, False]


def test_window_chrome(spark):
    assert values(spark, ["x", "_ □ ×", "ok", "·", "- x"], T.window_chrome("x")) == [True, True, False, False, True]


def test_labels_native_and_plain_agree(spark):
    rows = ["Medialnfo", "< Back", "Bakc >", "Next >", "Сlоsе", "Archives", "Camo Studio", "[ Extract All ]", "", "x File y", "a b", "supportt us", "No", "Nо", "Yess", "Dashbord", "→→", "settlngs", "ОК"]
    native = values(spark, rows, f"{parse_label('x')}.label")
    assert native == [folds.known_label(x) for x in rows]
    assert native[:6] == ["MediaInfo", "Back", None, "Next", "Close", "Archives"]
    assert values(spark, ["« back", "file"], f"{compose(parse_label('x'))}") == ["« Back", "File"]


def test_case_follows_the_source(spark):
    rows = [("SAVE", "сохранить"), ("Save", "сохранить"), ("save", "сохранить"), ("Save", " "), ("1 Save", "да")]
    assert values(spark, rows, T.case_style("x", "y")) == ["СОХРАНИТЬ", "Сохранить", "сохранить", "", "Да"]


def test_spacing(spark):
    assert values(spark, [("well-", "known"), ("a", ", b"), ("a", "b"), ("", "b")], T.inline_join("x", "y")) == ["well-known", "a, b", "a b", "b"]
    assert values(spark, [("(", "a"), ("a", ")"), ("a", "b"), ("co-", "op")], T.joins_without_space("x", "y")) == [True, True, False, True]


def test_language_codes(spark):
    assert values(spark, ["zh-Hans", "", None, "de"], T.bridge_code("x", "en")) == ["zh", "en", "en", "de"]
    assert values(spark, ["en-US", "zh-CN", "fr-FR", "ru"], T.language_tag("x")) == ["en", "zh-Hans", "fr-FR", "ru"]
    assert values(spark, ["en-US", "-x", "ru"], T.language_family("x")) == ["en", "-x", "ru"]

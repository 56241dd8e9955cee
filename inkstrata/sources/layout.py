"""Layout tables: recognised lines and words with boxes, one capture per document.

A line row is ``capture_id, line_ord, text, left, top, width, height, words``
with ``words`` an array of ``text, left, top, width, height`` (null where the
recogniser gave none, which is not the same as empty).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.functions.labels import let
from inkstrata.functions.text import normalize, skipped

WORD_TYPE = "struct<text: string, left: double, top: double, width: double, height: double>"
LINE_TYPE = f"capture_id long, line_ord long, text string, left double, top double, width double, height double, words array<{WORD_TYPE}>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(docs: DataFrame) -> DataFrame:
    """Lines with words from plain text, by integer geometry: no shuffle.

    Each text line is cut into rows of 3 to 10 words (by the document's id); two
    neighbouring pieces share a row, the second 900 to the right.  A text line of
    over 100,000 rows counts as several lines.  Documents with a null id have no
    capture and give no lines.
    """
    own = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("capture_id"), F.split(F.coalesce("text", F.lit("")), "\n").alias("ls")).withColumn("most", F.expr("CAST(100000 * (3 + pmod(capture_id, 8)) AS int)"))
    # a line of so many words has more characters than that
    cut = let("ts", "filter(split(l, ' '), t -> t <> '')", "transform(sequence(0, greatest(0, size(ts) - 1) div most), i -> array_join(slice(ts, CAST(i * most + 1 AS int), most), ' '))")
    lines = f"CASE WHEN exists(ls, l -> length(l) > most) THEN flatten(transform(ls, l -> CASE WHEN length(l) > most THEN {cut} ELSE array(l) END)) ELSE ls END"
    at = own.select("capture_id", F.posexplode(F.expr(lines)).alias("line_no", "line")).where("trim(BOTH ' ' FROM line) <> ''")
    at = at.withColumn("tokens", F.expr("split(trim(BOTH ' ' FROM line), ' +')")).withColumn("k", F.expr("CAST(3 + pmod(capture_id, 8) AS int)"))
    # pieces are cut inside the generator: a row carries its own words, not those of its whole line
    at = at.select("capture_id", "line_no", "k", F.posexplode(F.expr("transform(sequence(0, CAST((size(tokens) - 1) div k AS int)), c -> slice(tokens, c * k + 1, k))")).alias("chunk", "piece"))
    at = at.withColumn("line_ord", F.expr("CAST(line_no AS bigint) * 100000 + chunk")).withColumn("top", F.expr("CAST(20 * (CAST(line_no AS bigint) * 100000 + chunk div 2) AS double)"))
    gap = "4 + pmod(7 * capture_id + 5 * line_no + 3 * (chunk * k + {0}), 29)"
    # a line's own box comes from its text: who reads no words pays for none; out of a generator, so that filters above don't repeat it
    at = at.withColumn("own", F.array_join("piece", " ")).withColumn("n", F.size("piece"))
    box = {"text": "own", "left": f"CAST(chunk % 2 * 900 + {gap.format(0)} AS double)", "width": "CAST(8 * (length(own) - n + 1) + " + " + ".join(f"CASE WHEN n > {i} THEN {gap.format(i)} ELSE 0 END" for i in range(1, 10)) + " AS double)"}
    at = at.select("capture_id", "line_no", "k", "chunk", "piece", "line_ord", "top", F.inline(F.array(F.struct(*(F.expr(e).alias(c) for c, e in box.items())))))
    sizes = f"transform(piece, (w, i) -> named_struct('text', w, 'gap', CAST({gap.format('i')} AS double), 'width', CAST(8 * length(w) AS double)))"
    words = F.expr(
        f"""aggregate({sizes}, named_struct('at', CAST(chunk % 2 * 900 AS double), 'out', CAST(array() AS array<{WORD_TYPE}>)),
            (acc, s) -> named_struct('at', acc.at + s.gap + s.width, 'out', concat(acc.out, array(named_struct('text', s.text, 'left', acc.at + s.gap, 'top', top, 'width', s.width, 'height', 16D)))),
            acc -> acc.out)"""
    )
    return at.select("capture_id", "line_ord", "text", "left", "top", "width", F.lit(16.0).alias("height"), words.alias("words"))


def recognized_lines(words: DataFrame) -> DataFrame:
    """Line rows from a recogniser's words (capture_id, line_ord, word_ord, text, box) of a picture enlarged by ``scale`` and ``region_width`` x ``region_height`` large.

    Boxes are divided by the scale; a line's box holds all of its words, its
    words those with text and a box.  Lines without anything to read, measured
    against the region in the source's size, go.
    """
    box = ("left", "top", "width", "height")
    rows = words.withColumns({c: F.col(c) / F.col("scale") for c in (*box, "region_width", "region_height")})
    real = F.when(F.expr("trim(coalesce(text, '')) <> '' AND width > 0 AND height > 0"), F.struct("word_ord", F.struct("text", *box).alias("w")))
    right, bottom = F.max(F.col("left") + F.col("width")), F.max(F.col("top") + F.col("height"))
    lines = rows.groupBy("capture_id", "line_ord").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_ord", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), " ").alias("text"), F.min("left").alias("left"), F.min("top").alias("top"),
        (right - F.min("left")).alias("width"), (bottom - F.min("top")).alias("height"), F.transform(F.array_sort(F.collect_list(real)), lambda x: x["w"]).alias("words"), F.first("region_width").alias("rw"), F.first("region_height").alias("rh"),
    )
    kept = lines.where(F.expr(f"NOT {skipped('text', 'width', 'height', 'rw', 'rh')}"))
    return kept.select("capture_id", F.col("line_ord").cast("long").alias("line_ord"), F.expr(normalize("text")).alias("text"), *box, "words")


def words_of(lines: DataFrame) -> DataFrame:
    """One row per word of lines that have words."""
    return lines.select("capture_id", "line_ord", F.posexplode("words").alias("word_ord", "w")).select("capture_id", "line_ord", "word_ord", "w.text", "w.left", "w.top", "w.width", "w.height")


#: The same tables for the second engine: words, and lines as text with boxes.
LAYOUT_SQL = """split_lines AS (SELECT capture_id, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM (SELECT doc_id AS capture_id, string_split(text, chr(10)) AS l FROM documents)),
split_words AS (SELECT capture_id, line_no, 3 + capture_id % 8 AS k, unnest(t) AS text, unnest(range(len(t))) AS p FROM (SELECT *, list_filter(string_split(line, ' '), lambda x: x <> '') AS t FROM split_lines)),
placed AS (SELECT capture_id, line_no * 100000 + p // k AS line_ord, p % k AS word_ord, text, (p // k) % 2 * 900 AS base, 20 * (line_no * 100000 + (p // k) // 2) AS top, 8 * length(text) AS width, 4 + (7 * capture_id + 5 * line_no + 3 * p) % 29 AS gap FROM split_words),
words AS (SELECT capture_id, line_ord, word_ord, text, (base + sum(gap + width) OVER (PARTITION BY capture_id, line_ord ORDER BY word_ord) - width)::DOUBLE AS "left", top::DOUBLE AS top, width::DOUBLE AS width, 16::DOUBLE AS height FROM placed),
lines AS (SELECT capture_id, line_ord, string_agg(text, ' ' ORDER BY word_ord) AS text, min("left") AS "left", min(top) AS top, max("left" + width) - min("left") AS width, 16::DOUBLE AS height, count(*) AS n FROM words GROUP BY capture_id, line_ord)"""

"""Label parsing and fuzzy lexicon matching as Spark SQL expressions.

The lexicon is a constant of fixed size inside the expression: matching a text
is a filter over its labels of the same first letter, without a join or a
Python worker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstrata.functions.text import CONFUSABLES, LEFT_ARROWS, RIGHT_ARROWS, WORD, WRAPPERS, normalize, plain_key
from inkstrata.sources.lexicon import LABELS, compact


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _lexicon(key: str) -> str:
    """The labels that begin with a key's first letter: no other fits. Null where there are none."""
    by_letter: dict[str, list[str]] = {}
    for i, x in enumerate(LABELS):
        by_letter.setdefault(compact(x)[0], []).append(f"named_struct('ord', {i}, 'label', '{x}', 'compact', '{compact(x)}')")
    return f"element_at(map({', '.join(f"'{letter}', array({', '.join(own)})" for letter, own in by_letter.items())}), substring({key}, 1, 1))"


def best_label(key: str, left: str, right: str) -> str:
    """struct<eff, raw, ord, label> of the nearest fitting label of a compact key; null if none fits.

    ``left`` and ``right`` say whether arrows stood there: Back and Previous,
    Next and Continue then may differ by more.
    """
    arrow = f"(({left} AND l.label IN ('Back', 'Previous')) OR ({right} AND l.label IN ('Next', 'Continue')))"
    most = f"(CASE WHEN length(l.compact) <= 3 THEN 0 WHEN length(l.compact) <= 4 THEN 1 WHEN length(l.compact) <= 8 THEN 2 ELSE 3 END + CASE WHEN {arrow} THEN 2 ELSE 0 END)"
    starts = f"(substring({key}, 1, 1) = substring(l.compact, 1, 1) AND ({arrow} OR length({key}) <= 4 OR length(l.compact) <= 4 OR substring({key}, 1, 2) = substring(l.compact, 1, 2)))"
    fits = f"({key} = l.compact OR ({starts} AND abs(length({key}) - length(l.compact)) <= greatest(2, {most} + 1) AND levenshtein({key}, l.compact) <= {most}))"
    return f"array_min(transform(filter({_lexicon(key)}, l -> {fits}), l -> named_struct('eff', greatest(0, levenshtein({key}, l.compact) - CASE WHEN {arrow} THEN 1 ELSE 0 END), 'raw', levenshtein({key}, l.compact), 'ord', l.ord, 'label', l.label)))"


def parse_label(x: str) -> str:
    """struct<prefix, label, suffix> of a text that is a known label; null for any other."""
    head, tail = f"r'^[{LEFT_ARROWS}]+'", f"r'[{RIGHT_ARROWS}]+$'"
    bare = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(n, {head}, ''), {tail}, ''), r'^[{WRAPPERS}]+', ''), r'[{WRAPPERS}]+$', '')"
    tokens = let("t", f"regexp_extract_all({bare}, r'[{WORD}]+', 0)", let("i", "filter(sequence(1, greatest(1, size(t))), j -> length(try_element_at(t, j)) > 1)", "CASE WHEN size(i) > 0 THEN slice(t, i[0], i[size(i) - 1] - i[0] + 1) WHEN size(t) > 0 THEN slice(t, size(t), 1) ELSE t END"))
    best = let("k", f"CASE WHEN size(u) BETWEEN 1 AND 2 THEN {plain_key("array_join(u, ' ')")} ELSE '' END", let("c", "replace(k, ' ', '')", f"CASE WHEN c <> '' AND length(k) <= 18 THEN {best_label('c', "p <> ''", "s <> ''")} END"))
    whole = let("p", f"regexp_extract(n, {head}, 0)", let("s", f"regexp_extract(regexp_replace(n, {head}, ''), {tail}, 0)", let("u", tokens, let("b", best, "CASE WHEN b IS NOT NULL THEN named_struct('prefix', p, 'label', b.label, 'suffix', s) END"))))
    return let("n", normalize(x), f"CASE WHEN n <> '' THEN {whole} END")


def compose(parsed: str) -> str:
    """Prefix, label and suffix with spaces between those there are."""
    return f"concat_ws(' ', nullif({parsed}.prefix, ''), {parsed}.label, nullif({parsed}.suffix, ''))"


def letters_of(word: str) -> str:
    """What a word gives to the key of a text: its tokens of two letters or more; a mark where it has an arrow."""
    return f"CASE WHEN {word} RLIKE r'[{LEFT_ARROWS}{RIGHT_ARROWS}]' THEN '<' ELSE lower(translate(array_join(regexp_extract_all({word}, r'[{WORD}]{{2,}}', 0), ''), r'{CONFUSABLES[0]}', r'{CONFUSABLES[1]}')) END"


def may_be_label(letters: str) -> str:
    """A cheap test that every text with a label passes, by the letters of its words: how it begins, and its length.

    A key is at most as much longer or shorter than its label as letters may
    differ; beyond four letters of either it shares two with it.  A dot that a
    capital leaves behind (U+0307) is in no key: such words pass.
    """
    twos, ones = set(), set()
    for label in map(compact, LABELS):
        most = 0 if len(label) <= 3 else 1 if len(label) <= 4 else 2 if len(label) <= 8 else 3
        for n in range(len(label) - most, len(label) + most + 1):
            twos.add(f"{label[:2]}{n}")
            if min(n, len(label)) <= 4:
                ones.add(f"{label[:1]}{n}")
    listed = lambda x: ", ".join(f"'{s}'" for s in sorted(x))
    return f"(concat(substring({letters}, 1, 2), length({letters})) IN ({listed(twos)}) OR concat(substring({letters}, 1, 1), length({letters})) IN ({listed(ones)}) OR instr({letters}, '<') > 0 OR instr({letters}, '\u0307') > 0)"


def labelled(texts: DataFrame) -> DataFrame:
    """(text, parsed) of the distinct texts that are labels: each is matched once, by a join with the lexicon on the first letter.

    The lexicon is a constant of fixed size, so it is broadcast.  Matching is
    work, not bytes: the texts are dealt to all tasks, however few bytes they have.
    """
    spark = texts.sparkSession
    once = texts.select("text").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    head, tail = f"r'^[{LEFT_ARROWS}]+'", f"r'[{RIGHT_ARROWS}]+$'"
    rows = once.withColumn("n", F.expr(normalize("text"))).withColumns({"prefix": F.expr(f"regexp_extract(n, {head}, 0)"), "rest": F.expr(f"regexp_replace(n, {head}, '')")})
    rows = rows.withColumns({"suffix": F.expr(f"regexp_extract(rest, {tail}, 0)"), "t": F.expr(f"regexp_extract_all(regexp_replace(rest, {tail}, ''), r'[{WORD}]+', 0)")})
    # single letters at the ends go, unless there is nothing else
    rows = rows.withColumn("u", F.expr(let("i", "filter(sequence(1, greatest(1, size(t))), j -> length(try_element_at(t, j)) > 1)", "CASE WHEN size(i) > 0 THEN slice(t, i[0], i[size(i) - 1] - i[0] + 1) WHEN size(t) > 0 THEN slice(t, size(t), 1) ELSE t END")))
    # no filter here: it would be moved down, and with it all work above repeated; an empty key meets no label
    rows = rows.withColumn("spaced", F.expr(f"CASE WHEN size(u) BETWEEN 1 AND 2 THEN {plain_key("array_join(u, ' ')")} ELSE '' END")).withColumn("key", F.expr("CASE WHEN length(spaced) <= 18 THEN replace(spaced, ' ', '') ELSE '' END"))
    lexicon = spark.createDataFrame([(i, x, compact(x), compact(x)[0]) for i, x in enumerate(LABELS)], "ord int, label string, compact string, initial string")
    pairs = rows.select("text", "prefix", "suffix", "key", F.coalesce(F.substring("key", 1, 1), F.lit("")).alias("initial")).join(F.broadcast(lexicon), "initial")
    arrow = "((prefix <> '' AND label IN ('Back', 'Previous')) OR (suffix <> '' AND label IN ('Next', 'Continue')))"
    pairs = pairs.withColumn("arrow", F.expr(f"CASE WHEN {arrow} THEN 1 ELSE 0 END")).withColumn("most", F.expr("CASE WHEN length(compact) <= 3 THEN 0 WHEN length(compact) <= 4 THEN 1 WHEN length(compact) <= 8 THEN 2 ELSE 3 END + 2 * arrow"))
    near = "(arrow = 1 OR length(key) <= 4 OR length(compact) <= 4 OR substring(key, 1, 2) = substring(compact, 1, 2)) AND abs(length(key) - length(compact)) <= greatest(2, most + 1)"
    pairs = pairs.where(F.expr(f"key = compact OR ({near})")).withColumn("raw", F.levenshtein("key", "compact")).where("key = compact OR raw <= most")
    best = F.min(F.struct(F.greatest(F.lit(0), F.col("raw") - F.col("arrow")).alias("eff"), "raw", "ord", "label", "prefix", "suffix"))
    return pairs.groupBy("text").agg(best.alias("b")).select("text", F.struct("b.prefix", "b.label", "b.suffix").alias("parsed"))

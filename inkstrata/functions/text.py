"""Text functions: normalising, scripts, quality scores, label keys, spacing and case.

Each takes a dialect and SQL text of its arguments and returns SQL text, so the
same definition runs inside Spark's generated code and in the tests' second
engine.  Lengths count code points.
"""

from __future__ import annotations

from inkstrata.functions.dialect import SPARK, Dialect

# Character classes (insides of brackets) and sets of characters.
SPACE = r"\s\x0B\x85\p{Z}"
LATIN, CYRILLIC, KANA, HAN = r"\x{0041}-\x{024F}", r"\x{0400}-\x{052F}", r"\x{3040}-\x{30FF}", r"\x{3400}-\x{9FFF}"
WORD = r"\p{L}\p{Nd}"
SUSPICIOUS = r"@\x{FFFD}¤§"
SENTENCE = r"\.,;:!\?\"'\(\)\[\]\{\}—\-/"
CHROME = r"xX×\-_□◻◽"
LEFT_ARROWS, RIGHT_ARROWS = "<‹«←", ">›»→"
WRAPPERS = r" \.,:;\|/\\\(\)\[\]\{\}"
#: Cyrillic letters that look like Latin ones, and those.
CONFUSABLES = ("АаВвЕеКкМмНнОоРрСсТтУуХхІіЈјЬъ", "AABBEEKKMMHHOOPPCCTTYYXXIIJJbb")


#: Language codes and the regional tags that recognisers take.
LANGUAGE_TAGS = (("en", "en-US"), ("ru", "ru-RU"), ("de", "de-DE"), ("ja", "ja-JP"), ("zh-Hans", "zh-CN"))


def normalize(x: str, d: Dialect = SPARK) -> str:
    """White space of any kind to single spaces, none at the ends; null to the empty text."""
    return f"trim({d.sub(f'coalesce({x}, {chr(39)}{chr(39)})', f'[{SPACE}]+', ' ')})"


def word_count(x: str, d: Dialect = SPARK) -> str:
    return d.size(d.split(x))


def is_blank(x: str, d: Dialect = SPARK) -> str:
    return f"({normalize(x, d)} = '')"


def has_letter(x: str, d: Dialect = SPARK) -> str:
    return d.has(x, r"\p{L}")


def guess_language(x: str, d: Dialect = SPARK) -> str:
    """Language by counts of script ranges; null if none stands out."""
    latin, cyrillic, kana, han = (d.count(x, c) for c in (LATIN, CYRILLIC, KANA, HAN))
    return f"CASE WHEN {kana} > 0 THEN 'ja' WHEN {han} >= 2 THEN 'zh-Hans' WHEN {cyrillic} >= 2 AND {cyrillic} >= {latin} THEN 'ru' WHEN {latin} >= 2 THEN 'en' END"


def mixed_scripts(token: str, d: Dialect = SPARK) -> str:
    """Whether a token holds more than one of the four scripts."""
    return "(" + " + ".join(f"CASE WHEN {d.has(token, f'[{c}]')} THEN 1 ELSE 0 END" for c in (LATIN, CYRILLIC, KANA, HAN)) + " > 1)"


def broken(token: str, d: Dialect = SPARK) -> str:
    """Tokens over two characters without letters, with digits among letters, or with much punctuation."""
    letters, digits, marks = (d.count(token, c) for c in (r"\p{L}", r"\p{Nd}", r"\p{P}"))
    # most tokens are letters with a mark at most: one look finds that
    plain = f"NOT {d.has(token, r'^\p{L}+\p{P}?$')} AND " if d.spark else ""
    return f"(length({token}) > 2 AND {plain}({letters} = 0 OR ({digits} >= 2 AND {letters} >= 2) OR {marks} >= 2))"


def _tokens(x: str, test: str, d: Dialect) -> str:
    return d.size(d.filter(d.split(x), "t", test))


def _mixed(x: str, d: Dialect) -> str:
    """Tokens of mixed scripts; where the text as a whole has one script, no token is looked at."""
    found = _tokens(x, mixed_scripts("t", d), d)
    return f"(CASE WHEN {mixed_scripts(x, d)} THEN {found} ELSE 0 END)" if d.spark else found


def line_score(x: str, d: Dialect = SPARK) -> str:
    """Plausibility of a recognised line."""
    return f"(3 * {d.count(x, WORD)} - 12 * {d.count(x, SUSPICIOUS)} - 24 * {_mixed(x, d)} - 18 * {_tokens(x, broken('t', d), d)})"


def response_score(x: str, lines: str, preferred: str, d: Dialect = SPARK) -> str:
    """Plausibility of a whole recognition; null for an empty one."""
    # the normalised text is bound: it is made once, not once a term
    n = "bare" if d.spark else normalize(x, d)
    score = f"3 * {d.count(n, WORD)} + {d.count(n, SPACE)} - 15 * {d.count(n, SUSPICIOUS)} - 28 * {_mixed(n, d)} - 20 * {_tokens(n, broken('t', d), d)} - 6 * {_tokens(n, 'length(t) = 1', d)} + 10 * {lines}"
    out = f"CASE WHEN {n} <> '' AND {lines} > 0 THEN {score} + CASE WHEN lower({guess_language(n, d)}) = lower({preferred}) THEN 40 ELSE 0 END END"
    return f"element_at(transform(array({normalize(x, d)}), bare -> {out}), 1)" if d.spark else out


def window_chrome(x: str, d: Dialect = SPARK) -> str:
    """Glyphs of window buttons only."""
    return f"({d.has(x, f'^[{CHROME}]$')} OR (length({x}) > 1 AND {d.has(x, f'^[{CHROME} ·]+$')}))"


def skipped(x: str, width: str, height: str, region_width: str, region_height: str, d: Dialect = SPARK) -> str:
    """Lines and segments that hold nothing to read."""
    n = normalize(x, d)
    tiny = f"(length({n}) = 1 AND {width} / greatest(1, {region_width}) < 0.08 AND {height} / greatest(1, {region_height}) < 0.12)"
    return f"({n} = '' OR {width} <= 0 OR {height} <= 0 OR {window_chrome(n, d)} OR NOT {has_letter(n, d)} OR {tiny})"


def sentence_punctuation(x: str, d: Dialect = SPARK) -> str:
    return d.has(x, f"[{SENTENCE}]")


def standalone_kind(x: str, d: Dialect = SPARK, words: str | None = None) -> str:
    n = normalize(x, d)
    return f"CASE WHEN {words or word_count(n, d)} >= 6 OR length({n}) >= 30 OR {sentence_punctuation(n, d)} THEN 'Paragraph' ELSE 'TextLine' END"


def header_word(x: str, d: Dialect = SPARK) -> str:
    """Words that start like headings or are mostly capitals."""
    upper, letters = d.count(x, r"\p{Lu}"), d.count(x, r"\p{L}")
    return f"CASE WHEN {x} = '' THEN false WHEN length({x}) = 1 THEN {d.has(x, r'^[\p{Lu}\p{Nd}]')} ELSE {d.has(x, r'^\p{Lu}')} OR ({letters} > 0 AND {upper} >= greatest(2, {letters} - 1)) END"


def plain_key(x: str, d: Dialect = SPARK) -> str:
    """Look-alikes to Latin, lower-cased letters and digits, single spaces, all else dropped."""
    return f"trim({d.sub(d.sub(f'lower(translate(coalesce({x}, {chr(39)}{chr(39)}), {d.text(CONFUSABLES[0])}, {d.text(CONFUSABLES[1])}))', f'[^{WORD}{SPACE}]'), f'[{SPACE}]+', ' ')})"


def compact_key(x: str, d: Dialect = SPARK) -> str:
    """Lower-cased letters and digits."""
    return f"lower({d.sub(x, f'[^{WORD}]')})"


def inline_join(left: str, right: str, d: Dialect = SPARK) -> str:
    """Two fragments of a row as one text."""
    a, b = f"trim({left})", f"trim({right})"
    return f"CASE WHEN {a} = '' THEN {b} WHEN {b} = '' THEN {a} WHEN {d.has(a, '-$')} OR {d.has(b, '^[.,:]')} THEN concat({a}, {b}) ELSE concat({a}, ' ', {b}) END"


def joins_without_space(left: str, right: str, d: Dialect = SPARK) -> str:
    """Whether two tokens of a sentence stand together."""
    quotes = r"\"'"
    return f"(({d.has(left, '-$')} AND {d.has(right, f'^[{WORD}]')}) OR {d.has(right, rf'^[.,:;!?)\]{quotes}]')} OR {d.has(left, rf'[(\[{quotes}]$')})"


def case_style(source: str, translated: str, d: Dialect = SPARK) -> str:
    """The translated text in capitals, or with a capital first letter, where the source is."""
    s, t = f"trim({source})", normalize(translated, d)
    caps = f"({d.has(s, r'\p{L}')} AND {d.upper(s)} = {s})"
    first = d.group(s, r"^[^\p{L}]*(\p{L})", 1)
    head = f"({first} <> '' AND {d.upper(first)} = {first} AND lower({first}) <> {first})"
    return f"CASE WHEN {t} = '' THEN '' WHEN {caps} THEN {d.upper(t)} WHEN {head} THEN concat({d.upper(f'substring({t}, 1, 1)')}, substring({t}, 2)) ELSE {t} END"


def label_text(x: str, d: Dialect = SPARK) -> str:
    """A reading without spaces before commas and full stops."""
    return f"replace(replace({normalize(x, d)}, ' ,', ','), ' .', '.')"


def candidate_score(x: str, d: Dialect = SPARK) -> str:
    """Rank of one reading of a label."""
    tokens = d.split(x)
    words = d.size(tokens)
    marks = d.count(d.sub(x, "[-_]"), r"\p{P}")
    return (
        f"({line_score(x, d)} + CASE {words} WHEN 1 THEN 18 WHEN 2 THEN 10 WHEN 3 THEN 2 ELSE -14 END"
        f" + 3 * {_tokens(x, d.has('t', r'\p{L}'), d)} - 24 * {_tokens(x, f'length(t) = 1 AND {d.has(chr(116), chr(92) + "p{L}")}', d)} - 12 * {marks} - 18 * {_mixed(x, d)}"
        f" + CASE WHEN {d.count(x, WORD)} >= 4 AND {marks} = 0 THEN 8 ELSE 0 END + CASE WHEN {words} = 1 AND length({x}) >= 4 THEN 6 ELSE 0 END"
        f" + CASE WHEN {words} = 2 AND {_tokens(x, 'length(t) >= 3', d)} = 2 THEN 4 ELSE 0 END)"
    )


def language_tag(x: str) -> str:
    """Tags with regions to the languages that scores compare."""
    return f"CASE {x} " + " ".join(f"WHEN '{tag}' THEN '{code}'" for code, tag in LANGUAGE_TAGS) + f" WHEN '' THEN NULL ELSE {x} END"


def language_family(x: str) -> str:
    """What stands before the first hyphen, if anything does."""
    return f"CASE WHEN instr({x}, '-') > 1 THEN substring({x}, 1, instr({x}, '-') - 1) ELSE {x} END"


def bridge_code(x: str, empty: str) -> str:
    """Language codes as the offline translator names them."""
    return f"CASE WHEN {x} IS NULL OR trim({x}) = '' THEN '{empty}' WHEN lower({x}) = 'zh-hans' THEN 'zh' ELSE {x} END"


def effective_language(explicit: str, x: str, d: Dialect = SPARK) -> str:
    return f"coalesce(nullif(trim({explicit}), ''), {guess_language(x, d)})"

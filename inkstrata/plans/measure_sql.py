"""SQL of the text measure for a second engine: glyph by glyph, where the library counts characters by class."""

from __future__ import annotations

from inkstrata.functions.measure import BOLD, BOLD_FROM, FULL, GLYPHS, ROW, USUAL

_CLASSES = " ".join("WHEN strpos('" + chars.replace("'", "''") + f"', c) > 0 THEN {advance}" for advance, chars in GLYPHS)
ADVANCE = f"(CASE {_CLASSES} WHEN unicode(c) BETWEEN 768 AND 879 THEN 0 WHEN unicode(c) BETWEEN 4352 AND 4447 OR unicode(c) BETWEEN 11904 AND 40959 OR unicode(c) BETWEEN 44032 AND 55203 OR unicode(c) BETWEEN 63744 AND 64255 OR unicode(c) BETWEEN 65281 AND 65376 THEN {FULL} ELSE {USUAL} END)"
_GLYPHS = "regexp_extract_all({0}, '[^\\n]')"


def em(text: str) -> str:
    one = f"coalesce(list_sum(list_transform({_GLYPHS.format('line')}, lambda c: {ADVANCE})), 0)"
    return f"list_max(list_transform(string_split({text}, chr(10)), lambda line: {one}))::BIGINT"


def words(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '\\n|[^ \\n]+'), lambda t: {{'t': t, 'w': coalesce(list_sum(list_transform({_GLYPHS.format('t')}, lambda c: {ADVANCE})), 0)::BIGINT}})"


def bold(size: str) -> str:
    return f"(CASE WHEN {size} >= {BOLD_FROM} THEN {BOLD}::DOUBLE ELSE 1::DOUBLE END)"


def width(em: str, size: str) -> str:
    return f"({em} * {size} * {bold(size)} / 1000::DOUBLE)"


def rows(words: str, room: str, size: str) -> str:
    """Words, and the glyphs of those wider than a row, go through one reduction; ``k`` says what a part may do."""
    limit = f"floor({room} * 1000::DOUBLE / ({size} * {bold(size)}))"
    blank = next(advance for advance, chars in GLYPHS if " " in chars)
    part = lambda w, k: f"{{'r': 0::BIGINT, 'u': ({w})::BIGINT, 'k': {k}}}"
    parts = f"flatten(list_transform({words}, lambda piece: CASE WHEN piece.t = chr(10) THEN [{part('0', '3')}] WHEN piece.w > {limit} THEN list_transform({_GLYPHS.format('piece.t')}, lambda c, i: {part(ADVANCE, 'CASE WHEN i = 1 THEN 1 ELSE 2 END')}) ELSE [{part('piece.w', '0')}] END))"
    step = f"""CASE WHEN piece.k = 3 THEN {{'r': acc.r + 1, 'u': 0::BIGINT, 'k': 0}}
        WHEN piece.k = 1 THEN {{'r': acc.r + CASE WHEN acc.u > 0 THEN 1 ELSE 0 END, 'u': piece.u, 'k': 0}}
        WHEN acc.u = 0 OR acc.u + piece.u + CASE WHEN piece.k = 0 THEN {blank} ELSE 0 END <= {limit} THEN {{'r': acc.r, 'u': acc.u + piece.u + CASE WHEN piece.k = 0 AND acc.u > 0 THEN {blank} ELSE 0 END, 'k': 0}} ELSE {{'r': acc.r + 1, 'u': piece.u, 'k': 0}} END"""
    return f"list_reduce({parts}, lambda acc, piece: {step}, {{'r': 1::BIGINT, 'u': 0::BIGINT, 'k': 0}}).r"


def placed(shown: str) -> str:
    """Relations that end in ``overlay``: the boxes of ``shown`` on a surface 1,200 wide and 1e8 high."""
    row = f"{ROW}::DOUBLE"
    tenth = lambda x: f"round_even({x} * 10, 0) / 10"
    return f"""ordered AS (SELECT *, coalesce(lead(top) OVER (PARTITION BY capture_id ORDER BY top, "left", line_ord), 1e8 - 6) AS next_top, kind = 'Paragraph' OR source_line_count > 1 AS wrap, least(26::DOUBLE, greatest(11.5::DOUBLE, 0.94::DOUBLE * height)) AS font, greatest(0::DOUBLE, top - 1) AS y, {em('translated')} AS em, {words('translated')} AS words FROM {shown}),
wished AS (SELECT *, {width('em', 'font')} AS m, greatest(0::DOUBLE, "left" - CASE WHEN wrap THEN 3 ELSE 2 END) AS x, CASE WHEN y < 30 THEN 34 WHEN wrap THEN 8 ELSE 6 END AS gutter,
    CASE WHEN wrap THEN greatest(width + 22, width * 1.18::DOUBLE) ELSE greatest(width + 10, {width('em', 'font')} + 18, width * least(2.9::DOUBLE, greatest(1.12::DOUBLE, 0.98::DOUBLE * greatest(1, length(translated)) / greatest(1, length(source_text))))) END AS wish FROM ordered),
roomy AS (SELECT *, greatest(CASE WHEN wrap THEN 80 ELSE 40 END, 1200 - x - gutter) AS room, greatest(0::DOUBLE, "left" + width - wish - 2) AS anchored FROM wished),
moved AS (SELECT *, greatest(40::DOUBLE, 1200 - anchored - gutter) AS other, NOT wrap AND wish > room AND greatest(40::DOUBLE, 1200 - anchored - gutter) > room AS shift FROM roomy),
boxed AS (SELECT *, CASE WHEN shift THEN anchored ELSE x END AS box_left, greatest(10::DOUBLE, least(wish, CASE WHEN shift THEN other ELSE room END)) AS bw, least(1e8 - y, CASE WHEN wrap THEN greatest(height + 6, font * 1.38::DOUBLE * greatest(2, source_line_count) + 8) ELSE greatest(12::DOUBLE, height + 2, font * 1.34::DOUBLE) END) AS bh, greatest(0::DOUBLE, next_top - y - 2) AS free FROM moved),
broken AS (SELECT *, least(free, greatest(bh, {rows('words', 'greatest(10::DOUBLE, bw - 8)', 'font')} * font * {row} + 4)) AS taller FROM boxed),
grown AS (SELECT * EXCLUDE (bh), CASE WHEN NOT wrap AND m > greatest(10::DOUBLE, bw - 8) AND free >= font * 2.1::DOUBLE AND taller > bh + 2 THEN taller ELSE bh END AS bh FROM broken),
seeded AS (SELECT *, wrap OR bh > height * 1.6::DOUBLE AS flows, least(24::DOUBLE, greatest(10.5::DOUBLE, font)) AS seed, greatest(10.5::DOUBLE, 0.84::DOUBLE * least(24::DOUBLE, greatest(10.5::DOUBLE, font))) AS lowest FROM grown),
tried AS (SELECT capture_id, line_ord, max(s) AS s FROM (SELECT *, unnest(list_transform(range(0, 9), lambda k: seed - k * 0.5::DOUBLE)) AS s FROM seeded)
    WHERE s > lowest AND s * {row} <= bh - 4 AND CASE WHEN flows THEN {rows('words', 'greatest(10::DOUBLE, bw - 10)', 's')} * s * {row} <= bh - 4 ELSE {width('em', 's')} <= bw - 8 END GROUP BY ALL),
sized AS (SELECT * EXCLUDE (font), CASE WHEN s IS NOT NULL THEN greatest(lowest, {tenth('s')}) WHEN length(translated) <= length(source_text) + 4 THEN {tenth('greatest(lowest, 0.9::DOUBLE * font)')} ELSE lowest END AS font FROM seeded LEFT JOIN tried USING (capture_id, line_ord)),
fitted AS (SELECT *, CASE WHEN flows THEN least(greatest(bh, next_top - y - 2), greatest(bh, {rows('words', 'greatest(10::DOUBLE, bw - 10)', 'font')} * font * {row} + 8)) ELSE bh END AS tall FROM sized),
overlay AS (SELECT capture_id, line_ord, wrap, font, box_left, y AS box_top, bw AS box_width, tall AS box_height, CASE WHEN flows THEN font * {row} END AS line_height, deviation, kind, source_line_count FROM fitted WHERE bw > 10 AND tall > 6)"""

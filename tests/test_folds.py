"""Properties of the folds: input order does not matter, nothing is lost, captures do not mix."""

from hypothesis import given, settings
from hypothesis import strategies as st

import plain_folds as folds

WORD = st.sampled_from(["Save", "File", "alpha", "Beta-", "x", "longer words here", "7", ".", "Extract All"])
BOX = st.tuples(st.integers(0, 300), st.integers(0, 80), st.integers(1, 120), st.integers(6, 24))


@st.composite
def lines(draw):
    out = []
    for i in range(draw(st.integers(0, 9))):
        left, top, width, height = map(float, draw(BOX))
        text = draw(WORD)
        out.append({"capture_id": 1, "line_ord": i, "seg_ord": i, "text": text, "left": left, "top": top, "width": width, "height": height, "words": None, "kind": draw(st.sampled_from(["UiLabel", "TextLine", "Paragraph"])), "source": "primary", "wanted": True, "rank": 0, "score": len(text)})
    return out


@settings(max_examples=150, deadline=None)
@given(lines(), st.randoms())
def test_order_does_not_matter(rows, rng):
    mixed = rows[:]
    rng.shuffle(mixed)
    for fold in (folds.merge_same_row, folds.paragraph_blocks, folds.drop_covered, folds.insert_new, folds.merge_responses):
        assert fold([dict(r) for r in rows]) == fold([dict(r) for r in mixed])
    if rows:
        assert folds.visual_rows(rows) == folds.visual_rows(mixed)


@settings(max_examples=150, deadline=None)
@given(lines())
def test_nothing_is_lost(rows):
    merged = folds.merge_same_row(rows)
    letters = lambda xs: sorted(c for x in xs for c in x["text"] if not c.isspace())
    assert letters(merged) == letters(rows)
    blocks = folds.paragraph_blocks(rows)
    assert sum(b["source_lines"] for b in blocks) == len(rows) and letters(blocks) == letters(rows)
    assert all(b["source_lines"] == 1 for b in blocks if b["kind"] == "UiLabel")
    if rows:
        found = folds.visual_rows(rows)[0]
        assert 1 <= found["most_in_row"] <= len(rows) and found["visual_rows"] + found["most_in_row"] <= len(rows) + 1
    kept = folds.drop_covered(rows)
    assert all(not (a is not b and folds.same_text(a, b) and folds.coverage(a, b) >= 0.72 and folds.coverage(b, a) >= 0.72) for a in kept for b in kept)


@given(st.text("ab-. ", max_size=12), st.text("ab-. ", max_size=12))
def test_joined_text(a, b):
    joined = folds.join_inline(a, b)
    assert joined.replace(" ", "") == (a + b).replace(" ", "")


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_distance(a, b):
    d = folds.distance(a, b)
    assert d == folds.distance(b, a) and abs(len(a) - len(b)) <= d <= max(len(a), len(b)) and (d == 0) == (a == b)


@given(st.lists(st.sampled_from(["<ts1>", "</ts1>", "<ts2>", "</ts2>", "x", " ", "<ts3>"]), max_size=8))
def test_markers_are_sound_or_refused(parts):
    text = "".join(parts)
    runs = folds.marked_runs(text, {1: {"color": True}, 2: {"bold": True}})
    if runs is not None:
        assert "".join(r["text"] for r in runs) == folds.MARKER.sub("", text)

"""Plain versions of the order-dependent folds: one capture as a list of rows, for tests."""

from __future__ import annotations

import re
from typing import Any

from inkstrata.functions.text import CONFUSABLES, LEFT_ARROWS, RIGHT_ARROWS
from inkstrata.sources.lexicon import LABELS, compact

Row = dict[str, Any]


def normalized(text: str | None) -> str:
    return " ".join((text or "").split())


def words_in(text: str) -> int:
    return len([t for t in text.split(" ") if t])


_FOLD = str.maketrans(*CONFUSABLES)
_TOKEN = re.compile(r"[^\W_]+")
_KEYS = [(i, x, compact(x)) for i, x in enumerate(LABELS)]


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def known_label(text: str | None) -> str | None:
    """The lexicon's label of a text, by the same rules as the SQL expression."""
    n = normalized(text)
    core = n.lstrip(LEFT_ARROWS)
    left = len(core) < len(n)
    bare = core.rstrip(RIGHT_ARROWS)
    right = len(bare) < len(core)
    tokens = _TOKEN.findall(bare.strip(" .,:;|/\\()[]{}"))
    while len(tokens) > 1 and len(tokens[0]) == 1:
        tokens.pop(0)
    while len(tokens) > 1 and len(tokens[-1]) == 1:
        tokens.pop()
    spaced = " ".join(tokens).translate(_FOLD).lower()
    key = spaced.replace(" ", "")
    if not 1 <= len(tokens) <= 2 or not key or len(spaced) > 18:
        return None
    best = None
    for order, label, form in _KEYS:
        arrow = (left and label in ("Back", "Previous")) or (right and label in ("Next", "Continue"))
        most = (0 if len(form) <= 3 else 1 if len(form) <= 4 else 2 if len(form) <= 8 else 3) + 2 * arrow
        near = key[0] == form[0] and (arrow or min(len(key), len(form)) <= 4 or key[:2] == form[:2])
        if key != form and (not near or abs(len(key) - len(form)) > max(2, most + 1)):
            continue
        d = distance(key, form)
        if d <= most and (best is None or (max(0, d - arrow), d, order) < best[:3]):
            best = (max(0, d - arrow), d, order, label)
    return best[3] if best else None


def united(a: Row, b: Row) -> Row:
    left, top = min(a["left"], b["left"]), min(a["top"], b["top"])
    return {"left": left, "top": top, "width": max(a["left"] + a["width"], b["left"] + b["width"]) - left, "height": max(a["top"] + a["height"], b["top"] + b["height"]) - top}


def middle(r: Row) -> float:
    return r["top"] + r["height"] / 2


def upper_median(values: list[float]) -> float | None:
    return sorted(values)[len(values) // 2] if values else None


def reading_order(rows: list[Row], ordinal: str) -> list[Row]:
    return sorted(rows, key=lambda r: (r["top"], r["left"], r[ordinal]))


def join_inline(a: str, b: str) -> str:
    a, b = a.strip(), b.strip()
    if not a or not b:
        return a or b
    return a + b if a.endswith("-") or b[0] in ".,:" else f"{a} {b}"


def merge_text(parts: list[str]) -> str:
    """Lines as one text; no space after a hyphen that a letter or digit follows (the hyphen stays)."""
    out: list[str] = []
    for part in map(normalized, parts):
        if part:
            out += [part] if not out or (out[-1].endswith("-") and part[0].isalnum()) else [" ", part]
    return "".join(out)


def count_words(line: Row) -> int:
    """Words that the recogniser gave; of the text only where it gave none at all."""
    return words_in(normalized(line["text"])) if line.get("words") is None else len(line["words"])


def separate_labels(a: Row, b: Row, gap: float, size: float) -> bool:
    if not all(len(normalized(x["text"])) <= 18 and count_words(x) <= 2 for x in (a, b)):
        return False
    if known_label(a["text"]) and known_label(b["text"]):
        return True
    return gap > max(14, 0.95 * size) or gap > 0.32 * min(a["width"], b["width"])


def merge_same_row(rows: list[Row]) -> list[Row]:
    """Fragments of a visual row as one line, each compared with what has been merged so far."""
    out: list[Row] = []
    for r in reading_order([r for r in rows if normalized(r["text"]) and r["width"] > 0 and r["height"] > 0], "line_ord"):
        if out:
            a = out[-1]
            size, gap = max(1, a["height"], r["height"]), r["left"] - (a["left"] + a["width"])
            if abs(middle(a) - middle(r)) <= max(5, 0.38 * size) and -2 <= gap <= max(26, 2.4 * size) and not separate_labels(a, r, gap, size):
                both = sorted([*(a.get("words") or []), *(r.get("words") or [])], key=lambda w: w["left"])
                out[-1] = {**a, **united(a, r), "text": join_inline(a["text"], r["text"]), "words": both}
                continue
        out.append(r)
    return out


def paragraph_blocks(rows: list[Row]) -> list[Row]:
    """Lines below each other with like heights, widths and edges as one paragraph; labels stay alone."""
    rows = reading_order(rows, "line_ord")
    if not rows:
        return []
    region = max(r["left"] + r["width"] for r in rows) - min(r["left"] for r in rows)
    groups: list[tuple[Row, list[Row], bool]] = []  # box, lines, whether any line reads like prose
    for r in rows:
        long = r["kind"] == "Paragraph" or len(normalized(r["text"])) >= 24
        if groups and r["kind"] != "UiLabel":
            box, lines, prose = groups[-1]
            last = lines[-1]
            size, gap = max(1, last["height"], r["height"]), r["top"] - (last["top"] + last["height"])
            wide = min(box["width"], r["width"]) / max(1, region) >= 0.45
            alike = max(last["height"], r["height"]) / max(1, min(last["height"], r["height"])) <= 1.26
            edges = abs(box["left"] - r["left"]) <= max(18, 1.5 * size) and (abs(box["left"] + box["width"] - r["left"] - r["width"]) <= max(28, 2.1 * size) or abs(box["width"] - r["width"]) <= max(36, 0.18 * region))
            if lines[0]["kind"] != "UiLabel" and -2 <= gap <= max(10, 0.95 * size) and alike and wide and edges and (prose or long):
                lines.append(r)
                groups[-1] = (united(box, r), lines, prose or long)
                continue
        groups.append(({k: r[k] for k in ("left", "top", "width", "height")}, [r], long))
    out = []
    for i, (box, lines, _) in enumerate(groups):
        kinds = {x["kind"] for x in lines}
        kind = "UiLabel" if "UiLabel" in kinds else "Paragraph" if len(lines) > 1 or "Paragraph" in kinds else "TextLine"
        out.append({"capture_id": lines[0]["capture_id"], "seg_ord": i, "text": merge_text([x["text"] for x in lines]), **box, "kind": kind, "source_lines": len(lines), "line_text": lines[0]["text"].strip() if len(lines) == 1 else None, "line_height": upper_median([x["height"] for x in lines if x["height"] > 0])})
    return out


def visual_rows(rows: list[Row]) -> list[Row]:
    """How many visual rows there are and the most members of one; members are compared with their row's first."""
    count = most = now = 0
    anchor: Row | None = None
    for r in reading_order([r for r in rows if r["width"] > 0 and r["height"] > 0], "seg_ord"):
        if anchor is not None and abs(middle(anchor) - middle(r)) <= max(10, 0.8 * max(1, anchor["height"], r["height"])):
            now += 1
        else:
            count, now, anchor = count + 1, 1, r
        most = max(most, now)
    return [{"capture_id": rows[0]["capture_id"], "visual_rows": count, "most_in_row": most}]


def shared_area(a: Row, b: Row) -> float:
    return max(0.0, min(a["left"] + a["width"], b["left"] + b["width"]) - max(a["left"], b["left"])) * max(0.0, min(a["top"] + a["height"], b["top"] + b["height"]) - max(a["top"], b["top"]))


def coverage(target: Row, other: Row) -> float:
    """Share of the target's own area that the other covers."""
    return shared_area(target, other) / max(1, target["width"] * target["height"])


def same_text(a: Row, b: Row) -> bool:
    return (a["text"] or "").strip().upper() == (b["text"] or "").strip().upper()


class Kept:
    """Rows kept so far, by text and by bands of height, so that a new row meets few of them."""

    BAND = 64

    def __init__(self) -> None:
        self.rows: list[Row] = []
        self.by_text: dict[tuple[str, int], list[int]] = {}
        self.by_band: dict[int, list[int]] = {}

    def bands(self, r: Row, margin: float = 0.0) -> range:
        return range(int((r["top"] - margin) // self.BAND), int((r["top"] + r["height"] + margin) // self.BAND) + 1)

    def put(self, at: int, margin: float = 0.0) -> None:
        r = self.rows[at]
        for band in self.bands(r, margin):
            self.by_text.setdefault(((r["text"] or "").strip().upper(), band), []).append(at)
            self.by_band.setdefault(band, []).append(at)

    def add(self, r: Row, margin: float = 0.0) -> None:
        self.rows.append(r)
        self.put(len(self.rows) - 1, margin)

    def covers(self, r: Row, share: float) -> bool:
        """Whether a kept row has the row's text and is covered by it."""
        text = (r["text"] or "").strip().upper()
        return any(coverage(self.rows[at], r) >= share for band in self.bands(r) for at in self.by_text.get((text, band), ()))


def insert_new(rows: list[Row]) -> list[Row]:
    """Primary rows, and automation rows flagged ``wanted`` that no row so far has with the same text over 70 % of its area."""
    held = Kept()
    for r in reading_order([r for r in rows if r["source"] == "primary"], "seg_ord"):
        held.add(r)
    for r in sorted((r for r in rows if r["source"] != "primary" and r["wanted"]), key=lambda r: r["seg_ord"]):
        if not held.covers(r, 0.7):
            held.add(r)
    kept = held.rows
    return sorted(kept, key=lambda r: (r["top"], r["left"], r["source"] != "primary", r["seg_ord"]))


def drop_covered(rows: list[Row]) -> list[Row]:
    """Smallest boxes first; a box goes if a kept one has its text and lies in it by 72 % of the kept one's area."""
    kept = Kept()
    for r in sorted(rows, key=lambda r: (r["width"] * r["height"], r["top"], r["left"], r["seg_ord"])):
        if not kept.covers(r, 0.72):
            kept.add(r)
    return reading_order(kept.rows, "seg_ord")


def same_line(a: Row, b: Row) -> bool:
    least = max(1, min(max(1, a["width"] * a["height"]), max(1, b["width"] * b["height"])))
    if shared_area(a, b) / least >= 0.55:
        return True
    return abs(middle(a) - middle(b)) <= max(4, 0.45 * min(a["height"], b["height"])) and abs(a["left"] - b["left"]) <= max(12, 0.25 * min(a["width"], b["width"])) and same_text(a, b)


def merge_responses(rows: list[Row]) -> list[Row]:
    """Lines of ranked recognitions: a line replaces the first same one if it scores more, or is added."""
    # rows that are one line share area, or their middles are at most 4, or 0.45 of the smaller height, apart
    held = Kept()
    for r in sorted(rows, key=lambda r: (r["rank"], r["line_ord"])):
        near = sorted({at for band in held.bands(r, 4) for at in held.by_band.get(band, ())})
        for i in near:
            if same_line(held.rows[i], r):
                if r["score"] > held.rows[i]["score"]:
                    held.rows[i] = r
                    held.put(i, 4)
                break
        else:
            held.add(r, 4)
    return reading_order(held.rows, "line_ord")


def merge_boxes(boxes: list[Row], most: float) -> list[Row]:
    """Boxes of a row, left to right, joined while the gap to what has been joined is small."""
    out: list[Row] = []
    for b in sorted(boxes, key=lambda b: (b["left"], b["box_ord"])):
        if out:
            a = out[-1]
            if abs(middle(a) - middle(b)) <= max(4, 0.55 * min(a["height"], b["height"])) and b["left"] - (a["left"] + a["width"]) <= most:
                out[-1] = {**a, **united(a, b)}
                continue
        out.append(b)
    return out


MARKER = re.compile(r"<\s*(/?)\s*ts(\d+)\s*>", re.I)


def marked_runs(text: str | None, fragments: dict[int, Row]) -> list[Row] | None:
    """Runs of a text with style markers; None if markers nest, do not match, stay open, are unknown, or style nothing."""
    runs: list[Row] = []
    active: int | None = None
    at = 0

    def emit(piece: str) -> None:
        if not piece:
            return
        style = fragments[active] if active is not None else {}
        run = {"text": piece, "color": bool(style.get("color")), "bold": bool(style.get("bold")), "fragment": active}
        if runs and all(runs[-1][k] == run[k] for k in ("color", "bold", "fragment")):
            runs[-1]["text"] += piece
        else:
            runs.append(run)

    found = list(MARKER.finditer(text or ""))
    for m in found:
        emit(text[at : m.start()])
        ident = int(m[2])
        if ident not in fragments or (active is not None) != bool(m[1]) or (m[1] and active != ident):
            return None
        active = None if m[1] else ident
        at = m.end()
    if not found or active is not None:
        return None
    emit(text[at:])
    if not any(r["color"] or r["bold"] for r in runs) or not "".join(r["text"] for r in runs).strip():
        return None
    return runs

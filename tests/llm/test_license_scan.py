"""The set-similarity join against counting, and the base scan against plain search."""

import random
import re

import pytest

from inkstrata.llm import license_scan as L


def plain_links(templates, text, share):
    """All (template, first word of the block, common words) by looking at every block."""
    w, out = L.words_of(text), []
    for i, t in enumerate(templates):
        own = set(t)
        size = L.class_of(len(t))
        for start in range(0, len(w), size):
            common = len(own & set(w[start : start + 2 * size]))
            if own and common >= share * len(own) - 1e-9:
                out.append((i, start, common))
    return sorted(out)


@pytest.mark.parametrize("seed", range(25))
def test_join_loses_no_pair(seed):
    """Random templates and texts over few words, at several thresholds."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    share = rng.choice((0.5, 0.7, 0.8, 0.9, 1.0))
    templates = [rng.choices(words, k=rng.randint(1, 30)) for _ in range(8)]
    counts = {w: rng.randint(0, 100) for w in words}
    index = L.Index(templates, [["w1", "w2"]], counts, share)
    for _ in range(12):
        text = " ".join(rng.choices(words + ["other"] * rng.randint(0, 200), k=rng.randint(0, 300)))
        found = L.scan(index, [str(i) for i in range(8)], text)
        assert sorted((x["template"], x["first_word"], x["common"]) for x in found["links"]) == plain_links(templates, text, share)


def test_every_template_is_found_whole_and_damaged(spark):
    rng = random.Random(2)
    filler = [f"word{i}" for i in range(500)]
    rows, wanted = [], {}
    for i, (label, text) in enumerate(L.TEMPLATES):
        words = text.split()
        damaged = [w for k, w in enumerate(words) if k % 9 != 5]  # a word in nine is lost
        for j, body in enumerate((words, damaged)):
            at = rng.randrange(3000)
            rows.append((2 * i + j, " ".join(rng.choices(filler, k=at) + body + rng.choices(filler, k=700))))
            wanted[2 * i + j] = label
    rows.append((900, " ".join(rng.choices(filler, k=4000))))
    got = {r["doc_id"]: r for r in L.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in wanted.items():
        assert label in got[i]["labels"].split(","), (i, label)
        assert got[i]["score"] >= L.CONTAINMENT and got[i]["n_links"] == len(got[i]["links"]) > 0
    assert (got[900]["labels"], got[900]["score"], got[900]["n_links"]) == ("", 0.0, 0)


def test_base_places_and_odd_rows(spark):
    long = "x " * 200_000 + "All rights reserved " + "y" * 300_000 + " All rights-reserved."
    rows = [(1, None), (2, ""), (3, "CC BY cc-by, ccby CC\nBY"), (4, "GNU General Public License All RIGHTS reserved"), (4, "GNU General Public License All RIGHTS reserved"), (None, "cc by"), (5, long), (6, "\x00 --- ÄÖ ﬁ cc by"), (7, "rights reserved all rights")]
    docs = spark.createDataFrame([(i, t, "z", 3) for i, t in rows], "doc_id long, text string, labels string, n_words int")
    got = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in L.licenses(docs).collect()]
    wanted = []
    for i, t in rows:
        w = re.findall(L.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        hits = [(k, label) for phrase, label in L.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in hits]
        wanted.append((i, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(wanted, key=key)
    assert L.licenses(docs.limit(0)).count() == 0


def test_templates_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_WORDS", 10)
    with pytest.raises(ValueError, match="in parts"):
        L.licenses(spark.createDataFrame([(1, "a")], "doc_id long, text string"))

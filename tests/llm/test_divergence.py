"""The audit against Python's whole numbers, with tiles of every size."""

import collections
import random
import re

import pytest

from inkstrata.llm import divergence as V


def plain(rows, least):
    docs = [(lang or "", source or "", re.findall(V.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = collections.Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= least)
        counts = {s: collections.Counter(t for d in own if d[1] == s for t in d[2] if held[t] >= least) for s in {d[1] for d in own}}
        of_lang = sum(counts.values(), collections.Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(of_lang)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(terms)[:10], 1)]
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("x", "Y", "é", "ß", "语")] + ["the"] * 30
    rows = []
    for _ in range(300):
        lang = rng.choice(("en", "en", "en", "de", None, ""))
        source = rng.choice(("hot", "hot", "hot", None, "", "a", "é", "b", "c", "z9"))
        rows.append((lang, source, rng.choice((" ", "-", "1", "[")).join(rng.choices(words, k=rng.randint(0, 40)))))
    # a language without kept terms, one with a single source, a group of empty texts, repeated rows
    return rows + [("fr", "p", "seul"), ("fr", "q", ""), ("fr", "r", None), ("it", "only", "uno due"), ("en", "empty", None), ("en", "empty", "12 34"), rows[0], rows[0]]


def found(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("seed", "blocks", "chunk", "slab"), [(1, 8, 2048, 16), (2, 2, 5, 1), (3, 1, 3, 2), (4, 3, 1, 4)])
def test_audit_against_whole_numbers(spark, monkeypatch, seed, blocks, chunk, slab):
    monkeypatch.setattr(V, "BLOCK_GROUPS", blocks)
    monkeypatch.setattr(V, "CHUNK_TERMS", chunk)
    monkeypatch.setattr(V, "SLAB_CHUNKS", slab)
    rows = rows_of(seed)
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "lang string, source string, text string, value int, part string").repartition(3)
    wanted = plain(rows, 10)
    assert found(V.divergence(docs)) == wanted and len({r[0] for r in wanted}) == 4


def test_long_texts_many_folds_and_empty_tables(spark):
    long = " ".join(f"t{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}" for i in range(60_000))
    rows = [("en", "s", long), ("en", "s", long), ("en", "t", "ta " * 1000)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    folded = V.term_counts(docs, fold_terms=10).groupBy("lang", "source", "term").sum("n", "d").collect()
    assert {(r[1], r[2]): (r[3], r[4]) for r in folded}["s", "taa"] == (1200, 2)
    assert found(V.divergence(docs, least_documents=2)) == plain(rows, 2)
    assert V.divergence(docs.limit(0)).count() == 0


def test_long_division_is_exact():
    import numpy as np

    rng = random.Random(4)
    for _ in range(300):
        total = rng.choice((0, 5, 10**6, 10**12, 8 * 10**15))
        terms = rng.randint(1, 10**6)
        counts = [rng.randint(0, total) for _ in range(5)]
        got = V.shares(np.array([counts]), np.array([total]), terms)[0].tolist()
        assert got == [1 + 10**9 * (c + 2) // (total + 2 * terms) for c in counts]

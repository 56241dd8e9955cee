"""Scores against plain counting, frequent contexts dealt to several shards, and the trie against dictionaries."""

import collections
import math
import zlib

import numpy as np
import pytest

from inkstrata.llm import language_model
from inkstrata.llm.elias_fano import DISCOUNT, KEY_BITS, STEP, NgramTrie, codes_at, quantised, value_of

DATA = "/root/testdata/sf0.001"


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0


def plain_scores(rows):
    """doc -> (tokens, known, N, base score, score) by interpolated absolute discounting on dictionaries."""
    tokens = [(i, [*(t or "").encode().lower().split(), b"\n"]) for i, t in rows]
    c1, c2, c3 = collections.Counter(), collections.Counter(), collections.Counter()
    for i, w in tokens:
        if not held(i):
            c1.update(w)
            before = [b"\n", *w[:-1]]
            c2.update(zip(before, w, strict=True))
            c3.update((before[k - 1], w[k - 1], w[k]) for k in range(1, len(w)))
    context1, context2, kinds1, kinds2 = (collections.Counter() for _ in range(4))
    for (v, _), n in c2.items():
        context1[v] += n
        kinds1[v] += 1
    for (u, v, _), n in c3.items():
        context2[u, v] += n
        kinds2[u, v] += 1
    n, size = sum(c1.values()), len(c1)
    p1 = lambda w: (c1[w] + 0.1) / (n + 0.1 * (size + 1))

    def p2(v, w):
        if not context1[v]:
            return p1(w)
        return max(c2[v, w] - DISCOUNT, 0) / context1[v] + DISCOUNT * kinds1[v] / context1[v] * p1(w)

    def p3(u, v, w):
        if not context2[u, v]:
            return p2(v, w)
        return max(c3[u, v, w] - DISCOUNT, 0) / context2[u, v] + DISCOUNT * kinds2[u, v] / context2[u, v] * p2(v, w)

    out = collections.defaultdict(list)
    for i, w in tokens:
        before = [b"\n", *w[:-1]]
        exact = math.log10(p2(b"\n", w[0])) + sum(math.log10(p3(before[k - 1], w[k - 1], w[k])) for k in range(1, len(w)))
        out[i].append((len(w), sum(c1[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), exact))
    return out


@pytest.mark.parametrize("split_tokens", [language_model.SPLIT_TOKENS, 12])
def test_scores_against_counting(spark, monkeypatch, split_tokens):
    monkeypatch.setattr(language_model, "SHARD_KEYS", 3000)
    real = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 40").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in real] + [(100, "the the the the of the the of"), (101, None), (102, ""), (103, " \n"), (None, "no id of the the"), (104, "ÄÖ ß 漢字 😀"), (100, "repeated id of the"), (105, "word " * 3000)]
    docs = spark.createDataFrame([(i, t, b"x", 1) for i, t in rows], "doc_id long, text string, tokens binary, n_tokens long").repartition(5)
    wanted = plain_scores(rows)
    found = collections.defaultdict(list)
    encode = language_model.encode
    monkeypatch.setattr(language_model, "encode", lambda d: encode(d, 900))
    if split_tokens == 12:
        blocks = language_model.encode(docs)
        known, parts = language_model.frequent(blocks, 20_000, 12)
        assert len(known) > 20 and parts.max() > 10 and (np.diff(known.astype(object)) > 0).all()
    for r in language_model.score(docs, split_tokens).collect():
        assert r["held_out"] == held(r["doc_id"])
        found[r["doc_id"]].append((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]))
    assert found.keys() == wanted.keys()
    for i, own in wanted.items():
        for got, exact in zip(sorted(found[i]), sorted(own), strict=True):
            assert got[:3] == exact[:3] and got[3] == pytest.approx(exact[3], rel=1e-9)
            assert abs(got[4] - exact[4]) <= 0.75 * STEP * exact[0]  # half a step for each of a token's quantised numbers, no more together
    assert language_model.score(docs.limit(0)).count() == 0


def test_trie_against_dictionaries():
    rng = np.random.default_rng(3)
    contexts = np.sort(rng.choice(1 << 40, 300, replace=False).astype(np.uint64))
    pairs = sorted({(int(c), int(k)) for c, k in zip(rng.integers(0, 300, 2000), rng.integers(0, 1 << KEY_BITS, 2000), strict=True)})
    counts2 = rng.integers(1, 50, len(pairs))
    triples = sorted({(int(c), int(k)) for c, k in zip(rng.integers(0, len(pairs), 4000), rng.integers(0, 40, 4000), strict=True)})
    counts3 = rng.integers(1, 9, len(triples))
    of = lambda rows: (np.array([a for a, _ in rows], np.int64), np.array([b for _, b in rows], np.uint64))
    totals = np.bincount(of(pairs)[0], counts2, 300).astype(np.int64) + 1
    trie = NgramTrie.build(contexts, totals, (*of(pairs), counts2), (*of(triples), counts3)).mapped()
    assert (trie.find(contexts) == np.arange(300)).all() and (trie.find(contexts + np.uint64(1))[np.diff(contexts, append=np.uint64(0)) != 1] == -1).all()
    numbers, keys = of(pairs)
    assert (trie.pairs.find(numbers, keys) == np.arange(len(pairs))).all()
    asked = [(int(a), int(b)) for a, b in zip(rng.integers(-1, len(pairs), 3000), rng.integers(0, 60, 3000), strict=True)]
    where = {p: i for i, p in enumerate(triples)}
    assert trie.triples.find(*of(asked)).tolist() == [where.get(p, -1) for p in asked]
    share = value_of(codes_at(trie.pairs.codes, np.arange(len(pairs))))
    assert np.abs(np.log10(share) - np.log10((counts2 - DISCOUNT) / totals[numbers])).max() <= STEP / 2 + 1e-9
    assert codes_at(trie.pairs.codes, np.array([-1, 0])).tolist() == [0, int(trie.pairs.codes[0])]
    assert quantised(np.array([1.0, 0.0])).tolist() == [1, 255]

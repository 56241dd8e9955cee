"""The two classifiers against plain sums, and what each learns that a plainer model can't."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkstrata.llm import quality, toxicity

TEXTS = ["", "one", "one one one two", "漢字仮名交じり文には分かち書きがないので一つの語になる and more", "A | b | c!!! don't", " ".join(f"w{i % 37}" for i in range(500))]


def plain_rows(text, mask):
    """Each row of a text and its share, one n-gram after the other."""
    words = quality.TOKEN.findall(text)
    shares = {}
    put = lambda row, x: shares.__setitem__(row, shares.get(row, 0.0) + x)
    total = 2 * len(words) - 1
    for word in words:
        marked = f"<{word}>"
        own = {xxhash.xxh32_intdigest(word) & mask} | {xxhash.xxh32_intdigest(marked[i : i + n]) & mask for n in (3, 4) for i in range(len(marked) - n + 1)}
        for row in own:
            put(row, 1 / total / len(own))
    for a, b in zip(words, words[1:], strict=False):
        put(int(quality.pair_rows(np.array([xxhash.xxh64_intdigest(x) for x in (a, b)], np.uint64), mask)[0]), 1 / total)
    return shares


def test_quality_scores_against_plain_averages(spark, monkeypatch):
    rng = np.random.default_rng(0)
    model = quality.SubwordModel(rng.normal(size=(1 << 10, quality.WIDTH)).astype(np.float32), rng.normal(size=(2, quality.WIDTH)), rng.normal(size=2))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string")
    monkeypatch.setattr(quality, "_ROWS_AT_ONCE", 40)
    found = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for i, text in enumerate([*TEXTS, ""]):
        mean = sum((x * model.table[row].astype(np.float64) for row, x in plain_rows(text, 1023).items()), np.zeros(quality.WIDTH))
        z = model.output @ mean + model.bias
        assert found[i] == pytest.approx(1 / (1 + np.exp(z[0] - z[1])), abs=1e-5)
        ids, shares = quality.bag(text, quality.Grams(10))
        assert dict(zip(ids.tolist(), shares.tolist(), strict=True)) == pytest.approx(plain_rows(text, 1023), abs=1e-6)


def test_quality_steps_follow_the_gradient(monkeypatch):
    """One step of the fit is the loss's gradient by finite differences, times the rates."""
    monkeypatch.setattr(quality, "EPOCHS", 1)
    monkeypatch.setattr(quality, "LONGEST_STEP", 1e9)
    bags = [quality.bag(t, quality.Grams(8)) for t in ("good words here", "bad bad", "more good words", "bad bad bad bad")]
    labels = np.array([1, 0, 1, 0])
    tables, outputs = [], []
    for n in (3, 4):  # the fourth document's step is what a fit of four has done more
        order = np.random.default_rng(11)
        order.uniform(size=(256, quality.WIDTH))
        seen = order.permutation(4)[:n]
        monkeypatch.setattr(quality.np.random, "default_rng", lambda seed, seen=seen: FixedOrder(seen))
        model = quality.fit(bags, labels, 0.5, 8)
        tables.append(model.table.astype(np.float64))
        outputs.append((model.output, model.bias))
        monkeypatch.undo()
        monkeypatch.setattr(quality, "EPOCHS", 1)
        monkeypatch.setattr(quality, "LONGEST_STEP", 1e9)
    rows, shares = bags[seen[-1]]
    y, (output, bias) = labels[seen[-1]], outputs[0]
    rate = quality.RATE * (1 - 3 / 4)

    def loss(table, out):
        z = out @ (shares @ table[rows]) + bias
        return np.log(np.exp(z).sum()) - z[y]

    for row in rows[:5]:
        for k in range(quality.WIDTH):
            moved = tables[0].copy()
            moved[row, k] += 1e-5
            slope = (loss(moved, output) - loss(tables[0], output)) / 1e-5
            assert tables[1][row, k] - tables[0][row, k] == pytest.approx(-rate * quality.TABLE_RATE * slope, abs=2e-4)


class FixedOrder:
    """A random generator whose permutation is given."""

    def __init__(self, order):
        self.order, self.rng = order, np.random.Generator(np.random.PCG64(11))

    def uniform(self, *a):
        return self.rng.uniform(*a)

    def permutation(self, n):
        return self.order


@pytest.mark.parametrize("seed", range(2))
def test_toxicity_scores_against_plain_sums(spark, seed):
    rng = np.random.default_rng(seed)
    model = toxicity.FactorizationMachine(0.3, rng.normal(0, 0.3, 1 << 9).astype(np.float32), rng.normal(0, 0.2, (1 << 9, 4)).astype(np.float32))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS[:5], None])], "doc_id long, text string")
    hasher = toxicity.TermHasher.__init__
    toxicity.TermHasher.__init__, small = (lambda self, bits=9, stem=toxicity.STEM: hasher(self, bits, stem)), toxicity.TermHasher
    try:
        sets = {i: small().terms(t) for i, t in enumerate([*TEXTS[:5], ""])}
    finally:
        toxicity.TermHasher.__init__ = hasher
    for i, text in enumerate([*TEXTS[:5], ""]):
        words = {w for w in toxicity.WORD.findall(text.lower())}
        terms = sorted({xxhash.xxh32_intdigest(w) & 511 for w in words} | {xxhash.xxh32_intdigest("^" + w[: toxicity.STEM]) & 511 for w in words if len(w) > toxicity.STEM})
        assert sets[i].tolist() == terms
        plain = model.bias + sum(float(model.linear[t]) for t in terms)
        plain += sum(float(model.factors[a].astype(float) @ model.factors[b].astype(float)) for k, a in enumerate(terms) for b in terms[k + 1 :])
        got = model.logits(sets[i], np.array([0, len(terms)]))[0]
        assert got == pytest.approx(plain, abs=1e-5)
    full = toxicity.FactorizationMachine(0.3, np.zeros(1 << toxicity.BITS, np.float32), np.zeros((1 << toxicity.BITS, 4), np.float32))
    assert {round(r["score"], 6) for r in toxicity.score(docs, full).collect()} == {round(1 / (1 + np.exp(-0.3)), 6)}


def test_factors_learn_what_no_sum_can():
    """An insult is toxic only beside a mention of a group, and a mention only beside an insult."""
    rng = random.Random(4)
    sets, labels = [], []
    for _ in range(1600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        terms = [*rng.sample(range(100, 400), 12), *([1 + rng.randrange(2)] if insult else [3]), *([5 + rng.randrange(2)] if group else [7])]
        sets.append(np.unique(np.array(terms, np.int32)))
        labels.append(int(insult == group))  # neither alone says anything
    model = toxicity.fit(sets[:1200], np.array(labels[:1200]), 0.5, bits=9)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[1200:]])])
    rows, truth = np.concatenate(sets[1200:]), np.array(labels[1200:])
    right = lambda m: ((m.logits(rows, starts) > 0) == truth).mean()
    assert right(model) >= 0.95
    # the best weighted sum of the same terms stays near chance
    table = np.zeros((1600, 400))
    for i, terms in enumerate(sets):
        table[i, terms] = 1
    weights = np.linalg.lstsq(table[:1200], 2.0 * np.array(labels[:1200]) - 1, rcond=None)[0]
    assert ((table[1200:] @ weights > 0) == truth).mean() <= 0.6


def test_repeated_ids_count_once(spark):
    from inkstrata.llm.labelled import labelled_sample

    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, f"text {i} {k}") for i in ids for k in range(3)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    sample, prior = labelled_sample(docs, labels, "quality", 20)
    assert sample.count() == 40 and sample.where(F.col("text").endswith(" 0")).count() == 40
    assert prior == pytest.approx(sum(i % 2 for i in ids) / len(ids))

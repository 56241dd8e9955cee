"""Statistics over all items, results that don't depend on shards, and all windows scored in full."""

import collections
import math
import random

import numpy as np
import pytest

from inkstrata.llm import decontamination as d


def made(seed=9, items=90):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    vocabulary = [word() for _ in range(500)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(i, f"{sentence(rng.randrange(8, 40))}?\n{sentence(rng.randrange(6, 20))}.") for i in range(items)] + [(items, sentence(150) + ". " + sentence(30)), (items + 1, None), (items + 2, "--"), (0, "again another text of the same item. it has an answer of six words"), (None, "no id")]
    docs = [(i, sentence(rng.randrange(5, 400))) for i in range(60)]
    for k in range(0, items + 1, 2):
        words = bench[k][1].split()
        for _ in range(rng.randrange(0, len(words) // 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append((100 + k, f"{sentence(rng.randrange(200))} {' '.join(words)} {sentence(rng.randrange(200))}"))
    return bench, [*docs, (900, None), (901, ""), (902, docs[-1][1]), (902, docs[-1][1]), (None, docs[-1][1])]


def plain(bench, docs):
    """(doc, item, score) of every document and item, by full scoring of every window of every document."""
    items = sorted({(i, t) for i, t in bench if i is not None and t and d.words_of(t)})
    bags = [collections.Counter(d.words_of(t)) for _, t in items]
    n, mean = len(items), sum(sum(b.values()) for b in bags) / len(items)
    df = collections.Counter(w for b in bags for w in b)
    idf = {w: math.log(1 + (n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
    out = []
    for ident, text in docs:
        words = [w for w in map(d.bare, (text or "").lower().split()) if w]
        for (item, item_text), bag in zip(items, bags, strict=True):
            size = d.K1 * (1 - d.B + d.B * sum(bag.values()) / mean)
            impact = {w: idf[w] * k * (d.K1 + 1) / (k + size) for w, k in bag.items()}
            own = sum(impact.values())
            window = d.window_of(sum(bag.values()))
            best, near = 0.0, set()
            for at in range(0, max(1, len(words) - window + window // 4), window // 4):
                score = sum(impact.get(w, 0.0) for w in set(words[at : at + window])) / own
                if score >= d.THRESHOLD:
                    best = max(best, score)
                    part = words[max(0, at - window) : at + 2 * window]
                    near |= set(zip(part, part[1:], part[2:], strict=False))
            if best:
                shares = []
                for side in d.split_item(item_text):
                    grams = set(zip(side, side[1:], side[2:], strict=False))
                    shares.append(len(grams & near) / len(grams) if grams else 1.0)
                if min(shares) >= d.OVERLAP:
                    out.append((ident, item, round(best, 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "most"), [(d.SHARD, d.BROADCAST_BYTES), (20, d.BROADCAST_BYTES), (20, 1)])
def test_documents_against_full_scoring(spark, shard, most):
    bench, docs = made()
    benchmark = spark.createDataFrame([(i, t, 1, "w") for i, t in bench + bench[:5]], "item_id long, text string, n long, word string")
    documents = spark.createDataFrame([(i, t, "x", 2) for i, t in docs], "doc_id long, text string, words string, n_words long")
    found = sorted(((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in d.contaminated(documents, benchmark, shard, most).collect()), key=str)
    wanted = plain(bench, docs)
    assert found == wanted and len({i for i, *_ in wanted}) > 30
    kept = sorted(str(r["doc_id"]) for r in d.clean(documents, benchmark, "text", shard, most).collect())
    gone = {str(i) for i, *_ in wanted}
    assert kept == sorted(str(i) for i, _ in docs if str(i) not in gone)


def test_statistics_count_all_items(spark):
    bench, _ = made()
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    items, n, mean = d.statistics(benchmark)
    bags = [d.words_of(t) for _, t in {(i, t) for i, t in bench if i is not None and t and d.words_of(t)}]
    assert n == len(bags) and mean == pytest.approx(np.mean([len(b) for b in bags]))
    df = collections.Counter(w for b in bags for w in set(b))
    assert all(df[w] == k for r in items.collect() for w, k in r["frequencies"].items())
    assert d.indexes(benchmark.limit(0)).count() == 0

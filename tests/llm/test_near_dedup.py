"""Near-duplicate classes of a whole table against all pairs, and hot buckets dealt to several tasks."""

import collections
import random

from inkstrata.llm import near_dedup


def all_pair_classes(texts):
    """Classes by the exact weighted Jaccard index of every pair that shares a shingle; texts without words are equal."""
    bags = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        bags[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()
    holders = collections.defaultdict(list)
    for i in sorted(bags):
        for s in bags[i] or [()]:
            holders[s].append(i)
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen, links = set(), 0
    for group in holders.values():
        for n, a in enumerate(group):
            for b in group[n + 1 :]:
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                common, total = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
                if common >= near_dedup.SIMILARITY * total:
                    links += 1
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: root(i) for i in texts}, links


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wanted, links = all_pair_classes({r["doc_id"]: r["text"] for r in docs.collect()})
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert found == wanted and links > 20 and len(set(wanted.values())) < len(wanted)


def test_hot_buckets_lose_nothing(spark, monkeypatch):
    """Many texts that share a band but not enough shingles meet one by one, dealt to parts of a few rows."""
    monkeypatch.setattr(near_dedup, "HOT_BUCKET", 4)
    rng = random.Random(7)
    shared = [f"s{i}" for i in range(120)]
    texts = {}
    for k in range(60):
        own = [f"o{k // 3}_{i}" for i in range(60)]  # three texts of a kind, near each other, far from the rest
        words = own + shared
        for _ in range(k % 3):
            words[rng.randrange(60)] = f"z{k}"
        texts[k] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    wanted, _ = all_pair_classes(texts)
    assert found == wanted and 10 < len(set(wanted.values())) < 60

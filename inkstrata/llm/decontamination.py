"""Benchmark decontamination by a BM25 inverted index with block-max WAND.

The test items are indexed; every passage (window of words) of every training
document is a query against them.  Impacts are divided by an item's score
against itself, so one threshold serves items of any length.  Document
frequencies and the mean length are counted over all items in Spark.  Items are
put in classes by length, each with windows of its own size, and in shards of
at most ``SHARD`` items; each shard's index is built in a task and written.  A
scan of the documents carries as many indexes as ``BROADCAST_BYTES`` hold (one
scan for any usual benchmark), so the broadcast has a fixed bound at any number
of items, and no score depends on how items are dealt.

A window is first bounded by its terms' largest impacts in each of a few groups
of items (sums over strides of the text, no work per window); windows that could
reach the threshold in some group are searched by block-max WAND.  What it finds is verified on the
text: the item's question and its answer must both be there as word trigrams.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstrata.llm.common import materialise, text_of

K1, B = 1.2, 0.75
#: Share of an item's score against itself that a passage must reach.
THRESHOLD = 0.6
#: Share of the question's and of the answer's trigrams that the text must hold.
OVERLAP = 0.5
GRAM = 3
SHARD = 20_000
#: Bytes of written indexes that one scan of the documents carries.
BROADCAST_BYTES = 64 << 20
BLOCK = 16
#: Items in a group of the first bound, and how many groups a shard may have.
GROUP, MOST_GROUPS = 8, 32
SMALLEST_WINDOW = 64
MIN_ANSWER = 5
_MEMO_LIMIT = 500_000


def words_of(text: str) -> list[str]:
    """Lower-cased words between white space, without the punctuation around them."""
    return [w for w in (bare(x) for x in text.lower().split()) if w]


def bare(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}<>*#$%&|-_/\\")


def split_item(text: str) -> tuple[list[str], list[str]]:
    """(question, answer) words: the answer is what follows the last line or sentence end that leaves it ``MIN_ANSWER`` words.

    Where no such end exists, the last third of the words is the answer.
    """
    ends = [m.end() for m in re.finditer(r"\n+|[.?!:]\s+", text)]
    for end in reversed(ends):
        question, answer = words_of(text[:end]), words_of(text[end:])
        if len(answer) >= MIN_ANSWER and len(question) >= MIN_ANSWER:
            return question, answer
    all_words = words_of(text)
    cut = len(all_words) - len(all_words) // 3
    return all_words[:cut], all_words[cut:]


def window_of(n_words: int) -> int:
    """Window for an item: the power of two, at least ``SMALLEST_WINDOW``, that holds it."""
    return max(SMALLEST_WINDOW, 1 << max(0, n_words - 1).bit_length())


@dataclass
class Bm25Index:
    """Postings of one shard: for each term, item numbers ascending, impacts, and the largest impact of each block."""

    items: list[int]
    vocabulary: dict[str, int]
    postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    bound: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]
    window: int
    #: For each term (and one row of 0 for others) the largest impact in each group of neighbouring items.
    groups: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[int, str]], window: int, frequency: dict[str, int] | None = None, n_items: int = 0, mean: float = 0.0) -> Bm25Index:
        """Index (item id, text) rows; neighbours in length share blocks, so that block bounds are tight.

        ``frequency`` (items that hold a word), ``n_items`` and ``mean`` length
        are of all items; where they are not given, of ``rows``.
        """
        split = sorted(((i, *split_item(t)) for i, t in rows), key=lambda r: (len(r[1]) + len(r[2]), r[0]))
        bags = [Counter(q + a) for _, q, a in split]
        if frequency is None:
            frequency = Counter(w for bag in bags for w in bag)
            n_items, mean = len(bags), sum(sum(b.values()) for b in bags) / max(1, len(bags))
        vocabulary: dict[str, int] = {}
        for bag in bags:
            for w in bag:
                vocabulary.setdefault(w, len(vocabulary))
        idf = [math.log(1 + (n_items - frequency[w] + 0.5) / (frequency[w] + 0.5)) for w in vocabulary]
        lists: list[list[tuple[int, float]]] = [[] for _ in vocabulary]
        for number, bag in enumerate(bags):
            size = K1 * (1 - B + B * sum(bag.values()) / mean)
            impact = {w: idf[vocabulary[w]] * n * (K1 + 1) / (n + size) for w, n in bag.items()}
            own = sum(impact.values()) or 1.0
            for w, v in impact.items():
                lists[vocabulary[w]].append((number, v / own))
        postings = []
        for one in lists:
            at, value = np.array([x for x, _ in one]), np.array([v for _, v in one])
            postings.append((at, value, np.maximum.reduceat(value, np.arange(0, len(value), BLOCK))))
        bound = np.array([p[2].max() for p in postings] + [0.0])
        size = max(GROUP, -(-len(split) // MOST_GROUPS))
        groups = np.zeros((len(postings) + 1, -(-max(1, len(split)) // size)), np.float32)
        for term, (at, value, _) in enumerate(postings):
            np.maximum.at(groups[term], at // size, value)
        index = cls([i for i, *_ in split], vocabulary, postings, bound, [], window, groups)
        index.grams = [(index.codes(q), index.codes(a)) for _, q, a in split]
        return index

    def codes(self, words: list[str]) -> np.ndarray:
        return grams(np.array([self.vocabulary.get(w, -1) for w in words], dtype=np.int64), len(self.vocabulary))

    def search(self, terms: np.ndarray, least: float) -> list[tuple[int, float]]:
        """(item number, score) of all items that score at least ``least``, by block-max WAND."""
        lists = [(*self.postings[t], float(self.bound[t])) for t in terms]
        at = [0] * len(lists)
        found: list[tuple[int, float]] = []
        end = 1 << 60
        heads = [int(p[0][0]) for p in lists]
        while True:
            order = sorted(range(len(lists)), key=heads.__getitem__)
            reach, pivot = 0.0, -1
            for place, i in enumerate(order):
                if heads[i] == end:
                    break
                reach += lists[i][3]
                if reach >= least:
                    pivot = place
                    break
            if pivot < 0:
                return found
            target = heads[order[pivot]]
            while pivot + 1 < len(order) and heads[order[pivot + 1]] == target:
                pivot += 1
            # the blocks that hold the target, or would: their own maxima, and where the nearest of them ends
            reach, edge = 0.0, end
            for i in order[: pivot + 1]:
                docs, _, maxima, _ = lists[i]
                k = bisect_left(docs, target, at[i])
                if k < len(docs):
                    block = k // BLOCK
                    reach += float(maxima[block])
                    edge = min(edge, int(docs[min(len(docs), (block + 1) * BLOCK) - 1]) + 1)
            if reach >= least:
                score, goal = 0.0, target + 1
                for i in order[: pivot + 1]:
                    docs, impacts, _, _ = lists[i]
                    k = bisect_left(docs, target, at[i])
                    if k < len(docs) and docs[k] == target:
                        score += float(impacts[k])
                if score >= least:
                    found.append((target, score))
            else:
                goal = max(target + 1, min(edge, heads[order[pivot + 1]] if pivot + 1 < len(order) else end))
            for i in order[: pivot + 1]:
                docs = lists[i][0]
                at[i] = bisect_left(docs, goal, at[i])
                heads[i] = int(docs[at[i]]) if at[i] < len(docs) else end


def grams(ids: np.ndarray, size: int, n: int = GRAM) -> np.ndarray:
    """Codes of the word n-grams that hold only indexed words."""
    if len(ids) < n:
        return np.zeros(0, np.int64)
    code, ok = np.zeros(len(ids) - n + 1, np.int64), np.ones(len(ids) - n + 1, bool)
    for i in range(n):
        part = ids[i : len(ids) - n + 1 + i]
        code, ok = code * (size + 1) + part, ok & (part >= 0)
    return np.unique(code[ok])


class Matcher:
    """Finds the items of one shard in texts; remembers words already met in this task."""

    def __init__(self, index: Bm25Index, least: float = THRESHOLD, overlap: float = OVERLAP) -> None:
        self.index, self.least, self.overlap = index, least, overlap
        self.memo: dict[str, int] = {}

    def ids(self, words: list[str]) -> np.ndarray:
        if len(self.memo) > _MEMO_LIMIT:
            self.memo.clear()
        memo, vocabulary, out = self.memo, self.index.vocabulary, []
        for word in words:
            i = memo.get(word)
            if i is None:
                core = bare(word)
                i = memo[word] = vocabulary.get(core, -1) if core else -2
            out.append(i)
        ids = np.array(out, dtype=np.int64)
        return ids[ids > -2]

    def match(self, words: list[str]) -> list[tuple[int, float, float, float]]:
        """(item id, best score, question overlap, answer overlap) of the verified items of a whole text's lower-cased words."""
        index, window = self.index, self.index.window
        ids = self.ids(words)
        if not len(ids):
            return []
        stride = window // 4
        strides = np.add.reduceat(index.groups[ids], np.arange(0, len(ids), stride), axis=0)
        starts = np.arange(0, max(1, len(ids) - window + stride), stride)
        ends = np.minimum(starts + window, len(ids))
        reach = strides[: len(starts)].copy()
        for k in range(1, window // stride):
            part = strides[k : len(starts) + k]
            reach[: len(part)] += part
        best: dict[int, float] = defaultdict(float)
        where: dict[int, list[tuple[int, int]]] = defaultdict(list)
        least = self.least - 1e-4  # room for the rounding of 32-bit sums
        for k in np.flatnonzero(reach.max(axis=1) >= least):
            part = ids[starts[k] : ends[k]]
            terms = np.unique(part[part >= 0])
            if index.groups[terms].sum(axis=0).max(initial=0) < least:
                continue
            for item, score in index.search(terms, self.least):
                best[item] = max(best[item], score)
                where[item].append((int(starts[k]), int(ends[k])))
        found = []
        for item, score in best.items():
            codes = np.concatenate([grams(ids[max(0, a - window) : b + window], len(index.vocabulary)) for a, b in where[item]])
            question, answer = (float(np.isin(g, codes).mean()) if len(g) else 1.0 for g in index.grams[item])
            if question >= self.overlap and answer >= self.overlap:
                found.append((index.items[item], score, question, answer))
        return sorted(found)


def statistics(benchmark: DataFrame) -> tuple[DataFrame, int, float]:
    """(item_id, text, window, frequencies) of every test item with words, how many there are, and their mean length.

    ``frequencies`` holds, for each word of the item, how many items hold it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [words_of(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("item_id"), batch.column("text"), pa.array([len(b) for b in bags], pa.int64()), pa.array([window_of(len(b)) for b in bags], pa.int64()), pa.array([sorted(set(b)) for b in bags], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "text", "n_words", "window", "words"])

    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = materialise(rows.mapInArrow(run, "item_id long, text string, n_words long, window long, words array<string>").where("n_words > 0"), "items")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.avg("n_words"), F.lit(0.0)).alias("mean")).first()
    each = items.select("item_id", "text", "window", F.explode("words").alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("n"))
    held = each.join(counts, "word").groupBy("item_id", "text", "window").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("frequencies"))
    return held, size["n"], size["mean"]


def indexes(benchmark: DataFrame, shard: int = SHARD) -> DataFrame:
    """(window, part, index): the written index of each shard of at most about ``shard`` test items.

    Null and wordless items are left out; a repeated item counts once.
    """
    items, n, mean = statistics(benchmark)
    parts = max(1, -(-n // (shard // 2 or 1))) if n > shard else 1

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        frequency = {w: k for r in rows for w, k in r["frequencies"]}
        index = Bm25Index.build(sorted((r["item_id"], r["text"]) for r in rows), rows[0]["window"], frequency, n, mean)
        held = (index.items, index.vocabulary, index.postings, index.bound, index.grams, index.window, index.groups)
        return pa.table({"window": [rows[0]["window"]], "part": [rows[0]["part"]], "index": [pickle.dumps(held)]}, schema=pa.schema([("window", pa.int64()), ("part", pa.int64()), ("index", pa.binary())]))

    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    return materialise(dealt.groupBy("window", "part").applyInArrow(run, "window long, part long, index binary"), "indexes")


def scans(written: DataFrame, most: int = BROADCAST_BYTES) -> Iterator[Callable[[], list[Matcher]]]:
    """For each scan of the documents, what makes its matchers; a scan's indexes come to the driver as bytes, at most ``most`` of them (or one index)."""
    sizes = written.select("window", "part", F.octet_length("index").alias("size")).orderBy("window", "part").collect()
    groups: list[list] = []
    room = 0
    for r in sizes:
        if not groups or r["size"] > room:
            groups.append([])
            room = most
        groups[-1].append((r["window"], r["part"]))
        room -= r["size"]
    for group in groups:
        wanted = F.lit(False)
        for window, part in group:
            wanted = wanted | ((F.col("window") == window) & (F.col("part") == part))
        shared = written.sparkSession.sparkContext.broadcast([bytes(r["index"]) for r in written.where(wanted).orderBy("window", "part").collect()])
        yield lambda shared=shared: [Matcher(Bm25Index(*pickle.loads(data))) for data in shared.value]


def contaminated(docs: DataFrame, benchmark: DataFrame, shard: int = SHARD, most: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every document that holds a test item.

    Null and empty texts hold none; repeated rows are each reported; without
    test items the result is empty.  Items of fewer than ``GRAM`` words are
    found by score alone.  Other columns are not looked at.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = None
    for make in scans(indexes(benchmark, shard), most):

        def run(batches: Iterator[pa.RecordBatch], make: Callable[[], list[Matcher]] = make) -> Iterator[pa.RecordBatch]:
            matchers = make()
            for batch in batches:
                rows = []
                for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    words = text.lower().split()
                    rows += [(i, *hit) for matcher in matchers for hit in matcher.match(words)]
                if rows:
                    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", shard: int = SHARD, most: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a test item; all columns stay, nothing of ``docs`` is shuffled."""
    for make in scans(indexes(benchmark, shard), most):

        def run(batches: Iterator[pa.RecordBatch], make: Callable[[], list[Matcher]] = make) -> Iterator[pa.RecordBatch]:
            matchers = make()
            for batch in batches:
                words = ((t or "").lower().split() for t in batch.column(text).to_pylist())
                yield batch.filter(pa.array([not any(m.match(w) for m in matchers) for w in words], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

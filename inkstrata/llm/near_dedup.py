"""Near-duplicate classes by DartMinHash signatures and banded joining.

A document is the multiset of its five-word shingles (lower-cased words between
white space; a shorter text is one shingle).  The similarity of two documents is
the weighted Jaccard index of those multisets; documents linked at
``SIMILARITY`` or more, directly or through others, form a class.

1. One pass makes, for each document, a fingerprint of its words and the bands of
   its weighted signature.
2. Equal fingerprints are exact copies: one of them stands for all.
3. Documents that share a band are candidates.  A bucket is never expanded into
   its pairs: its members are compared with its leader (lowest id), then, as
   long as they are not yet in one component with them, with leaders picked by
   hash, and last with the members of other components of the bucket.  Every
   pair of a bucket is thus in one class already, or verified, or ruled out by
   a bound on its similarity that no linked pair can fail.
4. Verification computes the exact similarity from the shingle hashes of candidates.
5. Components grow by label propagation with pointer jumping on tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.llm.common import materialise, text_of

WORDS = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 6
#: Bits of a sketch: each says whether an odd number of a document's shingles falls to it.  Shingles that
#: two documents share cancel out, so the bits that differ are never more than the shingles that do.
SKETCH_BITS = 1024
#: Rounds with a leader picked by hash, before members of other components are compared one by one.
EXTRA_ROUNDS = 1
#: First leaders that a member is compared with: those it shares the most bands with.
FIRST_LEADERS = 2

#: Rows of a bucket's last round that one task takes: larger buckets are dealt to several.
HOT_BUCKET = 1000

#: Ids of candidates (8 bytes each) that may be sent to every task.
BROADCAST_ROWS = 2_000_000

_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POLY = np.uint64(0x100000001B3)
#: Distribution function of a Poisson count of mean 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(12)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well spread hashes of the given ones."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a whole text, and how often each occurs; none for a text without words."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = max(1, len(parts) - words + 1)
    out = np.full(n, np.uint64(min(len(parts), words)))
    for i in range(min(words, len(parts))):
        out = out * _POLY + hashes[i : i + n]
    return np.unique(mix(out), return_counts=True)


def dart_signature(elements: np.ndarray, weights: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Weighted MinHash of ``k`` coordinates by thrown darts.

    The plane of an element (weight by rank) is cut into unit cells, each with a
    Poisson number of darts that depend on the cell's hash alone.  A dart inside
    the element's weight counts; it belongs to one coordinate, which keeps its
    dart of lowest rank.  Ranks are explored to about ``(k ln k + 2k) / total
    weight``, so the work is O(elements + k log k), and on while a coordinate
    has no dart.  Two documents agree in a coordinate with the probability of
    their weighted Jaccard index.
    """
    weights = np.asarray(weights, dtype=np.float64)
    total = weights.sum()
    signature, filled, rank_of = np.zeros(k, np.uint64), np.zeros(k, bool), np.full(k, np.inf)
    if total <= 0:
        return signature
    cells = np.ceil(weights).astype(np.int64)
    of = np.repeat(np.arange(len(elements)), cells)
    level = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    base = mix(elements[of] + (level.astype(np.uint64) + np.uint64(1)) * _STEP + np.uint64(seed))
    limit = weights[of]
    low, high = 0, max(1, math.ceil((k * math.log(k) + 2 * k) / total))
    while not filled.all():
        ranks = np.arange(low, high, dtype=np.uint64)
        cell = mix((base[:, None] ^ ((ranks + np.uint64(1)) * _MIX_1)[None, :]).ravel())
        count = np.searchsorted(_POISSON, unit(cell), side="right")
        for d in range(int(count.max(initial=0))):
            at = np.flatnonzero(count > d)
            dart = mix(cell[at] + np.uint64((d + 1) * int(_STEP) % 2**64))
            row = at // len(ranks)
            inside = level[row] + unit(mix(dart + np.uint64(1))) < limit[row]
            dart, at = dart[inside], at[inside]
            rank = low + at % len(ranks) + unit(mix(dart + np.uint64(2)))
            place = (dart % np.uint64(k)).astype(np.int64)
            order = np.argsort(rank)[::-1]
            best = np.full(k, np.inf)
            best[place[order]] = rank[order]
            kept = np.zeros(k, np.uint64)
            kept[place[order]] = dart[order]
            better = best < rank_of
            signature[better], rank_of[better] = kept[better], best[better]
            filled |= better
        low, high = high, high * 2
    return signature


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One hash for each band of a signature."""
    table, key = signature.reshape(bands, rows), np.arange(1, bands + 1, dtype=np.uint64) * _STEP
    for r in range(rows):
        key = mix(key * _POLY + table[:, r])
    return key.view(np.int64)


def sketch(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Odd bits of a multiset, 64 to an integer, and its size as the last integer."""
    odd = np.bincount(set_hashes(elements, counts) % np.uint32(SKETCH_BITS), minlength=SKETCH_BITS) & 1
    bits = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
    return np.append(bits, counts.sum())


def sketches_near(a: str, b: str) -> str:
    """SQL: whether two sketches leave it open that the similarity is ``SIMILARITY``; false only for pairs below it.

    Sets of n shingles together that differ in d have a Jaccard index of (n - d) / (n + d).
    """
    n = SKETCH_BITS // 64
    differ = " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(n))
    return f"{1 + SIMILARITY}D * ({differ}) <= {1 - SIMILARITY}D * ({a}[{n}] + {b}[{n}]) + 1e-6D"


def set_hashes(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """32-bit hashes of (shingle, occurrence)."""
    of = np.repeat(np.arange(len(elements)), counts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(elements[of] + nth.astype(np.uint64) * _STEP).astype(np.uint32)


def pack_set(elements: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 32-bit hashes of (shingle, occurrence), byte planes apart so that they compress."""
    hashes = np.sort(set_hashes(elements, counts))
    return hashes.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_set(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted arrays of distinct hashes."""
    if len(a) + len(b) == 0:
        return 1.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, words (fingerprint), bands, sketch of every document with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                prints, bands, sketches = [], [], []
                for text in batch.column("text").to_pylist():
                    elements, counts = shingles(text)
                    prints.append(xxhash.xxh3_128_digest(" ".join(text.lower().split())))
                    signature = dart_signature(elements, counts, BANDS * ROWS)
                    bands.append(band_keys(signature) if len(elements) else np.zeros(0, np.int64))
                    sketches.append(sketch(elements, counts))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.binary()), pa.array(bands, longs), pa.array(sketches, longs)], ["doc_id", "words", "bands", "sketch"])

    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, words binary, bands array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, shingles (packed) of the documents whose ids are given.

    Few ids go to the texts; more than ``broadcast_rows``, and texts and ids meet by id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [pack_set(*shingles(t)) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    few = ids.count() <= broadcast_rows
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return rows.mapInArrow(run, "doc_id long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose exact similarity is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                keep = [similarity(unpack_set(x), unpack_set(y)) >= least for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): for every node of the edges (src, dst), the lowest id that it is linked with."""
    both = materialise(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("low")).select("id", F.least("id", "low").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        moved = step.join(jump, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("label"), (F.least("next", F.coalesce("far", "next")) < F.col("label")).alias("moved"))
        moved = materialise(moved, "labels")
        labels = moved.select("id", "label")
        if not moved.where("moved").limit(1).count():
            return labels


def joined(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labels (id, label) after the new links (a, b): only the classes that a link joins are looked at again."""
    of = lambda end, to: labels.select(F.col("id").alias(end), F.col("label").alias(to))
    between = found.join(of("a", "src"), "a").join(of("b", "dst"), "b").where("src <> dst").select("src", "dst").distinct()
    merged = components(between).select(F.col("id").alias("label"), F.col("label").alias("new"))
    return materialise(labels.join(merged, "label", "left").select("id", F.coalesce("new", "label").alias("label")), "classes")


def classes_of(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, label) of every document that shares a band with another: the lowest id of its class.

    ``texts`` has doc_id, bands and sketch, one row per text.
    """
    # dealt by bucket once: the counts and the join below share the exchange
    buckets = texts.select("doc_id", F.explode("bands").alias("bucket")).repartition("bucket")
    shared = buckets.groupBy("bucket").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = materialise(buckets.join(shared, "bucket"), "buckets")
    # only candidates are ever compared: their sketches and shingles go to tables of their own, once
    near = materialise(buckets.select("doc_id").distinct(), "near")
    sets = materialise(shingle_sets(docs, near), "sets")
    marks = materialise(texts.select("doc_id", "sketch").join(near, "doc_id"), "sketches")
    first = buckets.where("leader < doc_id").groupBy(F.col("leader").alias("a"), F.col("doc_id").alias("b")).agg(F.count("*").alias("shared"))
    order = Window.partitionBy("b").orderBy(F.desc("shared"), "a")
    first = first.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= FIRST_LEADERS).select("a", "b")
    tried = materialise(first, "tried")
    labels = joined(near.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("label")), materialise(verified(tried, sets), "links"))
    for turn in range(EXTRA_ROUNDS + 1):
        marked = buckets.select("bucket", "doc_id").join(labels.withColumnRenamed("id", "doc_id"), "doc_id")
        mixed = marked.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
        open_rows = marked.join(mixed, "bucket").join(marks, "doc_id").select("bucket", "doc_id", "label", "sketch")
        if turn < EXTRA_ROUNDS:
            open_rows = materialise(open_rows, "mixed")
            pick = F.struct(F.xxhash64("doc_id", "bucket", F.lit(turn)).alias("h"), "doc_id", "label", "sketch")
            lead = open_rows.groupBy("bucket").agg(F.min(pick).alias("lead")).select("bucket", "lead.*").drop("h")
        else:
            # the members outside a bucket's largest component against all of other components
            own = Window.partitionBy("doc_id")  # at most BANDS buckets
            open_rows = materialise(open_rows.withColumn("own", F.collect_list("bucket").over(own)), "mixed")
            size = open_rows.groupBy("bucket", "label").agg(F.count("*").alias("n"))
            main = size.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("rows"))
            main = materialise(main.select("bucket", F.col("m.label").alias("main"), (1 + F.floor(F.col("rows") / HOT_BUCKET)).alias("parts")), "main")
            # a large bucket's rows are dealt to parts by their ids, and each part meets all of the outsiders
            open_rows = open_rows.join(main, "bucket").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
            lead = open_rows.where("label <> main").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        # decided inside the join: what is surely too different never becomes a row, nor does a pair in all its buckets but one
        once = "" if turn < EXTRA_ROUNDS else " AND x.part = y.part AND array_min(array_intersect(x.own, y.own)) = x.bucket"
        pairs = open_rows.alias("x").join(lead.alias("y"), F.expr(f"x.bucket = y.bucket AND x.label <> y.label AND {sketches_near('x.sketch', 'y.sketch')}{once}"))
        fresh = pairs.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        fresh = materialise(fresh, "tried")
        labels = joined(labels, materialise(verified(fresh, sets), "links"))
        tried = tried.unionByName(fresh)
    return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (lowest id of the class), copy_of (lowest id with the same words) for every row.

    Null and empty texts have the same (no) words: they are copies of each
    other.  A row without an id has null for both.  Rows that repeat an id each
    get a row; an id given to different texts links their classes to its own.
    """
    table = materialise(signatures(docs), "signatures")
    # copies fold before they are shuffled; equal words have equal bands
    texts = materialise(table.groupBy("words").agg(F.min(F.struct("doc_id", "bands", "sketch")).alias("one")).select("words", "one.*"), "texts")
    label = classes_of(texts, docs)
    classes = texts.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("words", F.col("doc_id").alias("copy_of"), F.coalesce("label", "doc_id").alias("class_id"))
    out = table.select("doc_id", "words").join(classes, "words").select("doc_id", "class_id", "copy_of")
    none = docs.where(F.col("doc_id").isNull()).select(*(F.lit(None).cast("long").alias(c) for c in ("doc_id", "class_id", "copy_of")))
    return out.unionByName(none)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the one of lowest id, of equal rows any.

    Rows without an id belong to no class and stay.  All columns stay.
    """
    classes = materialise(near_duplicates(docs), "classes")
    gone = classes.where("doc_id <> class_id").select("doc_id").distinct()
    again = classes.where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    # a list of few ids goes to the texts, which then need no shuffle; a long one meets them by id
    gone, again = (F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids for ids in (gone, again))
    kept = docs.join(gone, "doc_id", "left_anti")
    # only rows of an id that occurs again need to be told apart
    one = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, "doc_id", "left_anti").unionByName(one).select(*docs.columns)

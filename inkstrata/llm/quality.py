"""Text quality by supervised subword embeddings.

Every word, every character n-gram of it, and every pair of neighbouring words
has a hashed row of a learned table; a document is the average over its words
(each the mean of its own rows) and its word pairs, and a softmax over two
classes reads that average.  Table and output are trained together by numpy
stochastic gradient descent on a bounded labelled sample.  A word that follows
itself makes the same n-gram whatever the word, as hashed pairs of rare words
are never met again in new text.

The table is ``2 ** BITS`` rows of ``WIDTH`` floats at any corpus size, so it
is broadcast; scoring reads each whole text once, in Arrow batches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from inkstrata.llm.labelled import labelled_sample, with_held_out

BITS = 18
WIDTH = 8
GRAMS = (3, 4)
EPOCHS = 10
RATE = 0.5
#: Learning rate of the table, relative to the output's, and the longest step that one document may make in it.
TABLE_RATE = 60.0
LONGEST_STEP = 2.0
TOKEN = re.compile(r"\w+|[^\w\s]+")
_MEMO_LIMIT = 300_000
#: Rows of new words that are read at once; more, and they are read in turns.
_ROWS_AT_ONCE = 1_000_000


#: Hash of the n-gram of a word that follows itself.
TWICE = np.uint64(xxhash.xxh64_intdigest("\0twice"))


def pair_rows(hashes: np.ndarray, mask: int) -> np.ndarray:
    """Rows of the neighbouring pairs of words given by their hashes."""
    first, second = hashes[:-1], hashes[1:]
    x = np.where(first == second, TWICE, (first ^ (first >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + second)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) & np.uint64(mask)).astype(np.int64)


class Grams:
    """Hashed rows of words; remembers the rows of character n-grams, of which there are few."""

    def __init__(self, bits: int = BITS) -> None:
        self.mask, self.memo = (1 << bits) - 1, {}

    def rows(self, word: str) -> list[int]:
        """Rows of one word: itself, and all of its n-grams."""
        marked = f"<{word}>"
        if len(self.memo) > _MEMO_LIMIT:
            self.memo.clear()
        memo, found = self.memo, {xxhash.xxh32_intdigest(word) & self.mask}
        for n in GRAMS:
            for i in range(len(marked) - n + 1):
                gram = marked[i : i + n]
                row = memo.get(gram)
                if row is None:
                    row = memo[gram] = xxhash.xxh32_intdigest(gram) & self.mask
                found.add(row)
        return list(found)


def tokens(text: str) -> list[str]:
    """Runs of word characters and runs of other printable characters, case kept."""
    return TOKEN.findall(text)


@dataclass
class SubwordModel:
    table: np.ndarray
    output: np.ndarray
    bias: np.ndarray


class Embedder:
    """Averages of a model's rows; remembers the mean row of words already met in this task."""

    def __init__(self, model: SubwordModel) -> None:
        self.model, self.grams = model, Grams(len(model.table).bit_length() - 1)
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, model.table.shape[1]), np.float32)
        self.hashes = np.zeros(0, np.uint64)

    def _word_means(self, lists: list[list[int]]) -> np.ndarray:
        sizes = np.array([len(x) for x in lists])
        flat = np.fromiter((r for x in lists for r in x), np.int64, sizes.sum())
        sums = np.add.reduceat(self.model.table[flat], np.cumsum(sizes) - sizes, axis=0)
        return sums / sizes[:, None].astype(np.float32)

    def means(self, texts: list[str]) -> np.ndarray:
        """One average for each text; the new words of all texts are looked up at once."""
        if len(self.at) > _MEMO_LIMIT:
            self.at.clear()
            self.rows, self.hashes = self.rows[:0], self.hashes[:0]
        at, fresh, numbered = self.at, [], []
        for text in texts:
            own = tokens(text)
            for word in set(own).difference(at):
                at[word] = len(at)
                fresh.append(word)
            numbered.append(np.array([at[w] for w in own], dtype=np.int64))
        if fresh:
            blocks, lists, held = [self.rows], [], 0
            for word in fresh:
                lists.append(self.grams.rows(word))
                held += len(lists[-1])
                if held >= _ROWS_AT_ONCE:
                    blocks.append(self._word_means(lists))
                    lists, held = [], 0
            self.rows = np.vstack([*blocks, self._word_means(lists)] if lists else blocks)
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, fresh), np.uint64, len(fresh))])
        out = np.zeros((len(texts), self.rows.shape[1]))
        for i, ids in enumerate(numbered):
            if len(ids):
                pairs = self.model.table[pair_rows(self.hashes[ids], self.grams.mask)].sum(axis=0, dtype=np.float64)
                out[i] = (self.rows[ids].sum(axis=0, dtype=np.float64) + pairs) / (2 * len(ids) - 1)
        return out


def probabilities(model: SubwordModel, means: np.ndarray) -> np.ndarray:
    """Softmax probability of class 1 for each row of means."""
    z = means @ model.output.T + model.bias
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e[:, 1] / e.sum(axis=1)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, bits: int = BITS, seed: int = 11) -> SubwordModel:
    """Stochastic gradient descent over documents given as (rows, weights) with weights summing to 1.

    No rows, or rows of one class, give a constant score.
    """
    rng = np.random.default_rng(seed)
    size = 1 << bits
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (size, WIDTH)).astype(np.float32)
    model = SubwordModel(table, np.zeros((2, WIDTH)), np.log([1 - prior, prior]))
    labels = np.asarray(labels, dtype=np.int64)
    if len(bags) == 0 or labels.min() == labels.max():
        return model
    share = np.bincount(labels, minlength=2) / len(labels)
    weight = 0.5 / share
    out, bias = model.output, np.zeros(2)
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            rate = RATE * (1 - done / steps)
            done += 1
            rows, share_of = bags[i]
            if len(rows) == 0:
                continue
            mean = share_of @ table[rows]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = p * (rate * weight[labels[i]])
            back = g @ out
            out -= np.outer(g, mean)
            bias -= g
            step = TABLE_RATE * np.outer(share_of, back)
            step *= min(1.0, LONGEST_STEP / max(1e-12, float(np.sqrt((step * step).sum()))))
            table[rows] -= step.astype(np.float32)
    return SubwordModel(table, out.astype(np.float64), bias + np.log([2 * (1 - prior), 2 * prior]))


def bag(text: str, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """(rows, weights) of one whole text."""
    words = tokens(text)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    total = 2 * len(words) - 1
    pairs = pair_rows(np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64), grams.mask)
    rows, weights = [pairs], [np.full(len(pairs), 1 / total)]
    for word, n in Counter(words).items():
        ids = grams.rows(word)
        rows.append(np.array(ids))
        weights.append(np.full(len(ids), n / total / len(ids)))
    ids, inverse = np.unique(np.concatenate(rows), return_inverse=True)
    return ids.astype(np.int32), np.bincount(inverse, np.concatenate(weights)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = 2500) -> SubwordModel:
    """Fit on the bounded labelled sample; rows and weights reach the driver, not texts."""
    sample, prior = labelled_sample(docs, labels, "quality", rows_per_class)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            bags = [bag(t, grams) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r, _ in bags], pa.binary()), pa.array([w.tobytes() for _, w in bags], pa.binary()), batch.column("y")],
                ["rows", "weights", "y"],
            )

    got = sample.mapInArrow(encode, "rows binary, weights binary, y int").toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("rows", "weights", "y")), strict=True))
    return fit([(np.frombuffer(r, np.int32), np.frombuffer(w, np.float32)) for r, w, _ in rows], np.array([y for *_, y in rows]), prior)


def score(docs: DataFrame, model: SubwordModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null text counts as empty.

    A text without tokens gets the score of the output's bias.  Repeated rows
    each get their own, equal, row; other columns of ``docs`` are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.output, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SubwordModel(*shared.value)
        embedder = Embedder(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                p = probabilities(model, embedder.means(batch.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return with_held_out(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Train on the labelled rows of ``docs`` and score all of ``docs``."""
    return score(docs, train(docs, labels), threshold)

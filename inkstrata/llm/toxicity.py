"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms (words, and the first letters of
longer words, so that inflected forms of an insult share weight).  The score
is ``sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2))``:
the factors learn what pairs of terms say beyond each of them alone.

The fit reads a bounded labelled sample (``labelled.ROWS_PER_CLASS``) as term
ids, not texts, and runs mini-batch AdaGrad in numpy.  The model is
``2 ** BITS`` rows of ``1 + FACTORS`` floats, whatever the corpus size, so it
is broadcast; every document is then scored over its whole text in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from inkstrata.llm.labelled import labelled_sample, with_held_out

BITS = 17
FACTORS = 4
STEM = 4
EPOCHS = 12
BATCH = 32
RATE = 0.1
DECAY = 2e-4
#: L1 pull on every weight, per document: terms without evidence go back to 0, so long texts add up no noise.
SPARSE = 1e-3
MIN_DOCS = 4
WORD = re.compile(r"\w+")
_MEMO_LIMIT = 400_000


class TermHasher:
    """Words to hashed term ids, remembering words already met in this task."""

    def __init__(self, bits: int = BITS, stem: int = STEM) -> None:
        self.mask, self.stem, self.memo = (1 << bits) - 1, stem, {}

    def _ids(self, word: str) -> tuple[int, ...]:
        ids = [xxhash.xxh32_intdigest(word) & self.mask]
        if len(word) > self.stem:
            ids.append(xxhash.xxh32_intdigest("^" + word[: self.stem]) & self.mask)
        return tuple(ids)

    def terms(self, text: str) -> np.ndarray:
        """Sorted distinct term ids of the whole text."""
        if len(self.memo) > _MEMO_LIMIT:
            self.memo.clear()
        memo, found = self.memo, []
        for word in set(WORD.findall(text.lower())):
            ids = memo.get(word)
            if ids is None:
                ids = memo[word] = self._ids(word)
            found.extend(ids)
        return np.unique(np.array(found, dtype=np.int32))


@dataclass
class FactorizationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Logits of documents laid end to end in ``rows``; ``starts`` has one more entry than documents."""
        ends = starts[1:]
        zero = np.zeros((1, self.factors.shape[1]))
        total = lambda a: np.vstack([zero, np.cumsum(a, axis=0)])
        w = np.concatenate([[0.0], np.cumsum(self.linear[rows], dtype=np.float64)])
        v = self.factors[rows].astype(np.float64)
        s, q = total(v), total(v * v)
        s, q = s[ends] - s[starts[:-1]], q[ends] - q[starts[:-1]]
        return self.bias + (w[ends] - w[starts[:-1]]) + 0.5 * (s * s - q).sum(axis=1)


def fit(term_sets: list[np.ndarray], labels: np.ndarray, prior: float, bits: int = BITS, factors: int = FACTORS, seed: int = 7) -> FactorizationMachine:
    """Fit by AdaGrad on balanced classes; ``prior`` then shifts the bias back to the corpus rate.

    No rows, or rows of one class only, give a constant score (``prior``).
    """
    size = 1 << bits
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    model = FactorizationMachine(float(np.log(prior / (1 - prior))), np.zeros(size, np.float32), np.zeros((size, factors), np.float32))
    labels = np.asarray(labels, dtype=np.float64)
    if len(term_sets) == 0 or labels.min() == labels.max():
        return model
    seen = np.zeros(size, np.int64)
    for terms in term_sets:  # distinct in each set
        seen[terms] += 1
    kept = [t[seen[t] >= MIN_DOCS] for t in term_sets]
    rng = np.random.default_rng(seed)
    w, v = np.zeros(size), rng.normal(0, 0.02, (size, factors))
    v[seen < MIN_DOCS] = 0
    gw, gv, b, gb = np.full(size, 1e-2), np.full((size, factors), 1e-2), 0.0, 1e-2
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for epoch in range(EPOCHS):
        order = rng.permutation(len(kept))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            lens = np.array([len(kept[i]) for i in pick])
            rows = np.concatenate([kept[i] for i in pick])
            of = np.repeat(np.arange(len(pick)), lens)
            vr = v[rows]
            s = np.stack([np.bincount(of, vr[:, f], len(pick)) for f in range(factors)], 1)
            q = np.bincount(of, (vr * vr).sum(1), len(pick))
            z = b + np.bincount(of, w[rows], len(pick)) + 0.5 * ((s * s).sum(1) - q)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) * weight[pick]
            ids, inv = np.unique(rows, return_inverse=True)
            g = np.bincount(inv, err[of], len(ids)) + DECAY * len(pick) * w[ids]
            h = np.stack([np.bincount(inv, err[of] * (s[of, f] - vr[:, f]), len(ids)) for f in range(factors)], 1) + DECAY * len(pick) * v[ids]
            gw[ids] += g * g
            gv[ids] += h * h
            gb += err.sum() ** 2
            step = RATE / np.sqrt(gw[ids])
            moved = w[ids] - step * g
            w[ids] = np.sign(moved) * np.maximum(np.abs(moved) - step * SPARSE * len(pick), 0)
            step = RATE / np.sqrt(gv[ids])
            moved = v[ids] - step * h
            v[ids] = np.sign(moved) * np.maximum(np.abs(moved) - step * SPARSE * len(pick), 0)
            b -= RATE * err.sum() / np.sqrt(gb)
    return FactorizationMachine(b + float(np.log(prior / (1 - prior))), w.astype(np.float32), v.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame) -> FactorizationMachine:
    """Fit on the bounded sample; only term ids reach the driver."""
    sample, prior = labelled_sample(docs, labels, "toxic")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TermHasher()
        for batch in batches:
            sets = [hasher.terms(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), batch.column("y")], ["terms", "y"])

    rows = sample.mapInArrow(encode, "terms binary, y int").toArrow()
    # the sample's order depends on the partitioning: sort it, so that a fit repeats exactly
    pairs = sorted(zip(rows.column("terms").to_pylist(), rows.column("y").to_pylist(), strict=True))
    del rows
    pa.default_memory_pool().release_unused()
    labels_of = np.array([y for _, y in pairs])
    return fit([np.frombuffer(t, np.int32) for t, _ in pairs], labels_of, prior)


def score(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null text counts as empty.

    An empty text has no terms: its score is that of the bias.  Repeated rows
    each get their own, equal, row; other columns of ``docs`` are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.linear, model.factors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, machine = TermHasher(), FactorizationMachine(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [hasher.terms(t) for t in batch.column("text").to_pylist()]
                starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
                z = machine.logits(np.concatenate(sets), starts)
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return with_held_out(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Train on the labelled rows of ``docs`` and score all of ``docs``."""
    return score(docs, train(docs, labels), threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that a model trained on their labels scores at ``threshold`` or more; nothing is shuffled."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.linear, model.factors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, machine = TermHasher(), FactorizationMachine(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [hasher.terms(t or "") for t in batch.column("text").to_pylist()]
                starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
                p = 1 / (1 + np.exp(-np.clip(machine.logits(np.concatenate(sets), starts), -40, 40)))
                yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)

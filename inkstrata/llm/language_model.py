"""Language-model scoring by an Elias-Fano n-gram trie.

Model: word unigrams, bigrams and trigrams of the training documents, by
interpolated absolute discounting:
``p(w | u v) = max(c(u v w) - D, 0) / c(u v) + D t(u v) / c(u v) p(w | v)``, where t counts
different continuations, likewise ``p(w | v)`` from ``p(w)``, and
``p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))``.  A context that was never seen leaves
all to the shorter one.

The model grows with the corpus, so no task ever holds all of it:

1. Blocks of about ``BLOCK_TOKENS`` tokens are encoded where they are read:
   a vocabulary of word hashes, and each token as a number in it.
2. Each block asks for its distinct words, and for its distinct pairs with the
   words that follow them, with its own training counts: one packed row for each
   shard.  A context's pairs go to one shard; contexts of more than
   ``SPLIT_TOKENS`` tokens, and pairs that occur as often, are dealt to several
   by the next word, so that no shard grows with the corpus.
3. A shard adds the counts up, builds its trie in memory-mapped levels, and
   answers every block with counts, quantised probabilities and weights.
4. Answers meet their blocks, and tokens add up to scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstrata.llm.common import id_remainder, materialise, text_of
from inkstrata.llm.elias_fano import KEY_BITS, EliasFano, NgramTrie, codes_at, value_of

BLOCK_TOKENS = 1_000_000
SHARD_KEYS = 700_000
#: Tokens of a context or pair beyond which its continuations are dealt to several shards.
SPLIT_TOKENS = 300_000
#: Contexts and pairs that may be dealt so (their list goes to every task): beyond it, ``SPLIT_TOKENS`` grows.
MOST_SPLIT = 200_000
#: The end token; no word contains white space.
END = b"\n"
#: Bytes of a word's and of a context's hash that are sent to its shard.
WORD_BYTES, CONTEXT_BYTES = 6, 5
_MASK = np.uint64((1 << 63) - 1)
_KEY = np.uint64((1 << KEY_BITS) - 1)

BLOCKS = "block long, n_docs int, doc_ids binary, no_id binary, held binary, lengths binary, vocabulary binary, tokens binary, train_tokens long, n_tokens long"
ASKED = "kind int, shard int, block long, contexts binary, totals binary, runs binary, keys binary, counts binary, runs3 binary, keys3 binary, counts3 binary"
ANSWERS = "kind int, shard int, block long, counts binary, weights binary, codes binary, weights3 binary, codes3 binary, distinct long"


def planes(a: np.ndarray) -> bytes:
    """An integer array by byte planes, which compress."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()


def unplanes(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def cut(hashes: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of hashes, by byte planes."""
    return planes(hashes)[: size * len(hashes)]


def uncut(data: bytes, size: int) -> np.ndarray:
    return unplanes(data + bytes((8 - size) * (len(data) // size)), np.uint64)


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words(text: str) -> list[bytes]:
    """Tokens: A-Z lower-cased, split at ASCII white space (space, tab to carriage return)."""
    return text.encode().lower().split()


class Block:
    """Documents being encoded, then arrays of one block."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.held: list[bool] = []
        self.lengths: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.size = 0

    def add(self, ident: int | None, held: bool, text: str) -> None:
        own = words(text)
        self.ids.append(ident)
        self.held.append(held)
        own.append(END)
        self.lengths.append(len(own))
        self.size += len(own)
        self.hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)) & _MASK)

    def encoded(self, number: int) -> tuple:
        import zstandard

        vocabulary, inverse, counts = np.unique(np.concatenate(self.hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # common words get small numbers, which compress
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        lengths, held = np.array(self.lengths, np.uint32), np.array(self.held, bool)
        return (
            number, len(self.ids), np.array([i or 0 for i in self.ids], np.int64).tobytes(), np.array([i is None for i in self.ids], bool).tobytes(), held.tobytes(), lengths.tobytes(),
            vocabulary[order].tobytes(), zstandard.compress(planes(rank[inverse])), int(lengths[~held].sum()), int(lengths.sum()),
        )


def encode(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of encoded documents: whole texts, in the order they are read."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = Block(), TaskContext.get().partitionId() << 32

        def row(block: Block, number: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(block.encoded(number), [pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.int64(), pa.int64()], strict=True)], names)

        for batch in batches:
            for ident, held, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
                block.add(ident, held, text)
                if block.size >= block_tokens:
                    yield row(block, number)
                    block, number = Block(), number + 1
        if block.ids:
            yield row(block, number)

    rows = docs.select("doc_id", (id_remainder(10) == 0).alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(run, BLOCKS)


class Opened:
    """Arrays of a block row: tokens, the word before each, and where each document starts."""

    def __init__(self, row: dict) -> None:
        import zstandard

        self.block = row["block"]
        self.held = np.frombuffer(row["held"], bool)
        self.lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        self.tokens = unplanes(zstandard.decompress(row["tokens"]), np.uint32).astype(np.int64)
        self.train = np.repeat(~self.held, self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        # a document's first token follows an end
        end = int(np.flatnonzero(self.vocabulary == (np.uint64(xxhash.xxh3_64_intdigest(END)) & _MASK))[0])
        self.before = np.concatenate([[end], self.tokens[:-1]])
        self.before[self.starts] = end

    def pair_hash(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return spread(self.vocabulary[first] * np.uint64(3) + spread(self.vocabulary[second])) & _MASK

    def often(self, least: float) -> Iterator[tuple[int, int]]:
        """(hash, tokens) of the words and pairs that occur at least ``least`` times here as contexts."""
        words = np.bincount(self.before, minlength=len(self.vocabulary))
        some = np.flatnonzero(words >= least)
        yield from zip(self.vocabulary[some].astype(np.int64).tolist(), words[some].tolist(), strict=True)
        both = (words[self.before] >= least) & (words[self.tokens] >= least)
        codes, n = np.unique(self.before[both] * len(self.vocabulary) + self.tokens[both], return_counts=True)
        codes, n = codes[n >= least], n[n >= least]
        yield from zip(self.pair_hash(codes // len(self.vocabulary), codes % len(self.vocabulary)).astype(np.int64).tolist(), n.tolist(), strict=True)


def parts_of(hashes: np.ndarray, split: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Over how many shards the continuations of each context are dealt: 1 but for those in ``split`` (sorted hashes, parts)."""
    known, parts = split
    out = np.ones(len(hashes), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = known[at] == hashes
        out[hit] = parts[at[hit]]
    return out


class Asked(Opened):
    """A block with its questions: words by shard, pairs by shard and context, and what follows each pair.

    The order of words, contexts, pairs and triples in the questions is that in
    which ``scores`` reads the answers.
    """

    def __init__(self, row: dict, shards: tuple[int, int], split: tuple[np.ndarray, np.ndarray]) -> None:
        super().__init__(row)
        self.shards = shards
        size = len(self.vocabulary)
        shard = (spread(self.vocabulary) % np.uint64(shards[0])).astype(np.int64)
        self.word_order = np.argsort(shard, kind="stable")
        self.word_cuts = np.searchsorted(shard[self.word_order], np.arange(shards[0] + 1))
        # pairs, ordered by shard, then context, then next word
        codes, pair_of = np.unique(self.before * size + self.tokens, return_inverse=True)
        first, second = codes // size, codes % size
        parts = parts_of(self.vocabulary, split)
        key = self.vocabulary & _KEY
        shard = self._dealt(self.vocabulary[first], key[second], parts[first])
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair_of = place[pair_of]
        self.first, self.second, self.pair_shard = first[order], second[order], shard[order]
        # triples of tokens that do not start a document: the pair before and the token
        inside = np.ones(len(self.tokens), bool)
        inside[self.starts] = False
        self.inside = np.flatnonzero(inside)
        triples, triple_of = np.unique(self.pair_of[self.inside - 1] * size + self.tokens[self.inside], return_inverse=True)
        pair, third = triples // size, triples % size
        hashes = self.pair_hash(self.first, self.second)
        heavy = parts_of(hashes, split)
        # triples of frequent pairs are asked apart, dealt by their last word
        apart = heavy[pair] > 1
        shard3 = np.where(apart, shards[1] + self._dealt(hashes[pair], key[third], heavy[pair]), 0)
        order = np.argsort(shard3, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.triple_of = place[triple_of]
        self.pair, self.third, self.triple_shard = pair[order], third[order], shard3[order]
        self.near = int(np.searchsorted(self.triple_shard, 1))
        self.hashes, self.heavy, self.parts, self.key = hashes, heavy, parts, key

    def _dealt(self, contexts: np.ndarray, keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
        part = np.where(parts > 1, keys.astype(np.int64) % np.maximum(parts, 1), 0)
        return self._at(contexts, part)

    def _at(self, contexts: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (spread(contexts + spread(part.astype(np.uint64))) % np.uint64(self.shards[1])).astype(np.int64)

    def groups(self, shard: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, context, run) of the runs of equal shard and context; frequent contexts have a run, maybe empty, in each of their shards."""
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(shard) != 0) | (np.diff(context) != 0)])) if len(shard) else np.zeros(0, np.int64)
        return shard[edge], context[edge], np.diff(np.concatenate([edge, [len(shard)]]))

    def questions(self) -> Iterator[tuple]:
        counts = np.bincount(self.tokens[self.train], minlength=len(self.vocabulary)).astype(np.uint32)
        for s in np.flatnonzero(np.diff(self.word_cuts)):
            part = self.word_order[self.word_cuts[s] : self.word_cuts[s + 1]]
            yield 1, int(s), self.block, b"", b"", b"", cut(self.vocabulary[part], WORD_BYTES), planes(counts[part]), b"", b"", b""
        context_counts = np.bincount(self.before[self.train], minlength=len(self.vocabulary)).astype(np.uint32)
        counts2 = np.bincount(self.pair_of[self.train], minlength=len(self.first)).astype(np.uint32)
        train3 = self.train[self.inside]
        counts3 = np.bincount(self.triple_of[train3], minlength=len(self.pair)).astype(np.uint32)
        # pairs with the triples that stay with them
        runs3 = np.bincount(self.pair[: self.near], minlength=len(self.first)).astype(np.uint32)
        cuts3 = np.concatenate([[0], np.cumsum(runs3, dtype=np.int64)])
        keys2, keys3 = self.key[self.second], self.key[self.third]
        for s, contexts, runs, a, b in self.packed(self.pair_shard, self.first, self.vocabulary, self.parts, 0):
            x, y = cuts3[a], cuts3[b]
            yield 2, s, self.block, cut(self.vocabulary[contexts], CONTEXT_BYTES), planes(context_counts[contexts]), planes(runs.astype(np.uint32)), cut(keys2[a:b], 4), planes(counts2[a:b]), planes(runs3[a:b]), cut(keys3[x:y], 4), planes(counts3[x:y])
        near = self.near
        for s, contexts, runs, a, b in self.packed(self.triple_shard[near:], self.pair[near:], self.hashes, self.heavy, self.shards[1]):
            a, b = a + near, b + near
            yield 3, s, self.block, cut(self.hashes[contexts], CONTEXT_BYTES), planes(counts2[contexts]), planes(runs.astype(np.uint32)), cut(keys3[a:b], 4), planes(counts3[a:b]), b"", b"", b""

    def packed(self, shard: np.ndarray, context: np.ndarray, hashes: np.ndarray, parts: np.ndarray, offset: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
        """(shard, contexts, runs, from, to) of each shard's questions.

        A frequent context is named in all of its shards, so that each of them
        knows how often it occurs; its runs come first where they are empty.
        """
        shards, contexts, runs = self.groups(shard, context)
        often = parts[contexts] > 1
        there = set(zip(shards[often].tolist(), contexts[often].tolist(), strict=True))
        extra: dict[int, list[int]] = {}
        for c in np.flatnonzero(parts > 1).tolist():
            for s in set((offset + self._at(np.full(parts[c], hashes[c], np.uint64), np.arange(parts[c]))).tolist()):
                if (s, c) not in there:
                    extra.setdefault(s, []).append(c)
        edges = np.flatnonzero(np.concatenate([[True], np.diff(shards) != 0])) if len(shards) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(runs)])
        bounds = {int(shards[e]): (e, f) for e, f in zip(edges.tolist(), [*edges[1:].tolist(), len(shards)], strict=False)}
        for s in sorted(set(bounds) | set(extra)):
            e, f = bounds.get(s, (0, 0))
            more = np.array(extra.get(s, []), np.int64)
            yield s, np.concatenate([more, contexts[e:f]]), np.concatenate([np.zeros(len(more), np.int64), runs[e:f]]), int(ends[e]), int(ends[f])


def frequent(blocks: DataFrame, n_tokens: int, split_tokens: int = SPLIT_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the contexts and pairs of more than ``split_tokens`` tokens, and over how many shards each is dealt.

    A block leaves out what is rarer in it than a quarter of that share, so
    counts may fall short by a quarter; at most ``MOST_SPLIT`` hashes come back.
    """
    split_tokens = max(split_tokens, 2 * n_tokens // MOST_SPLIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = list(Opened(row).often(max(1.0, split_tokens * row["n_tokens"] / max(1, n_tokens) / 4)))
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["hash", "n"])

    rows = blocks.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") > split_tokens).collect()
    known = sorted((r["hash"], 2 + r["n"] // split_tokens) for r in rows)
    return np.array([h for h, _ in known], np.uint64), np.array([p for _, p in known], np.int64)


def ask(blocks: DataFrame, shards: tuple[int, int], split: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One packed row for each shard that a block's words, pairs or triples belong to."""
    names, types = [c.split()[0] for c in ASKED.split(", ")], [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(Asked(batch.slice(i, 1).to_pylist()[0], shards, split).questions())
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64], strict=True), types, strict=True)], names)

    return blocks.mapInArrow(run, ASKED)


def answer_words(rows: list[dict]) -> Iterator[tuple]:
    keys = [uncut(r["keys"], WORD_BYTES) for r in rows]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([unplanes(r["counts"], np.uint32) for r in rows]), len(distinct)).astype(np.int64)
    known = total > 0
    level, values = EliasFano.build(distinct[known]), total[known]
    at = level.successor(distinct)
    hit = level.contains(distinct, at)
    counts = np.zeros(len(distinct), np.int64)
    counts[hit] = values[at[hit]]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    for i, (row, own) in enumerate(zip(rows, np.split(counts[inverse], cuts), strict=True)):
        yield 1, row["shard"], row["block"], planes(own), b"", b"", b"", b"", int(known.sum()) if i == 0 else 0


def merged(of: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (number above, key) in order, which of them each row is, and their counts added up."""
    entries, inverse = np.unique((of.astype(np.uint64) << np.uint64(KEY_BITS)) | keys, return_inverse=True)
    return (entries >> np.uint64(KEY_BITS)).astype(np.int64), entries & _KEY, inverse, np.bincount(inverse, counts, len(entries)).astype(np.int64)


def answer_ngrams(rows: list[dict]) -> Iterator[tuple]:
    """Counts of all blocks added up, the shard's trie, and what it says of every question; each distinct question is looked up once."""
    join = lambda column, read: np.concatenate([read(r[column]) for r in rows])
    numbers = lambda data: unplanes(data, np.uint32).astype(np.int64)
    sizes = lambda column, width: np.cumsum([len(r[column]) // width for r in rows])[:-1]
    contexts, number = np.unique(join("contexts", lambda x: uncut(x, CONTEXT_BYTES)), return_inverse=True)
    totals = np.bincount(number, join("totals", numbers), len(contexts)).astype(np.int64)
    of2, key2, at2, total2 = merged(np.repeat(number, join("runs", numbers)), join("keys", lambda x: uncut(x, 4)), join("counts", numbers))
    runs3 = join("runs3", numbers)
    of3, key3, at3, total3 = merged(np.repeat(at2[: len(runs3)], runs3), join("keys3", lambda x: uncut(x, 4)), join("counts3", numbers))
    # only what was seen in training is in the model
    new = lambda seen: np.cumsum(seen) - 1
    seen1, seen2, seen3 = totals > 0, total2 > 0, total3 > 0
    trie = NgramTrie.build(contexts[seen1], totals[seen1], (new(seen1)[of2[seen2]], key2[seen2], total2[seen2]), (new(seen2)[of3[seen3]], key3[seen3], total3[seen3])).mapped()
    found1 = trie.find(contexts)
    found2 = trie.pairs.find(found1[of2], key2)
    found3 = trie.triples.find(found2[of3], key3)
    weights, codes = codes_at(trie.pairs.weights, found1)[number], codes_at(trie.pairs.codes, found2)[at2]
    weights3, codes3 = codes_at(trie.triples.weights, found2)[at2], codes_at(trie.triples.codes, found3)[at3]
    parts = (np.split(weights, sizes("contexts", CONTEXT_BYTES)), np.split(codes, sizes("keys", 4)), np.split(weights3, sizes("keys", 4)), np.split(codes3, sizes("keys3", 4)))
    for i, row in enumerate(rows):
        two = row["kind"] == 2
        yield row["kind"], row["shard"], row["block"], b"", parts[0][i].tobytes(), parts[1][i].tobytes(), parts[2][i].tobytes() if two else b"", parts[3][i].tobytes(), 0


def answers(asked: DataFrame) -> DataFrame:
    """Each shard's counts added up, its trie built, and every block's questions answered."""
    names, types = [c.split()[0] for c in ANSWERS.split(", ")], [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.int64()]

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        out = list((answer_words if rows[0]["kind"] == 1 else answer_ngrams)(rows))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return asked.groupBy("kind", "shard").applyInArrow(run, ANSWERS)


def scores(blocks: DataFrame, answered: DataFrame, shards: tuple[int, int], split: tuple[np.ndarray, np.ndarray], n: int, v: int) -> DataFrame:
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        asked = Asked(row, shards, split)
        count = np.zeros(len(asked.vocabulary), np.int64)
        weight2, known2 = np.zeros(len(asked.vocabulary)), np.zeros(len(asked.vocabulary), bool)
        weight3, known3 = np.zeros(len(asked.first)), np.zeros(len(asked.first), bool)
        code2, code3 = np.zeros(len(asked.first), np.uint8), np.zeros(len(asked.pair), np.uint8)
        near = asked.near
        cuts3 = np.concatenate([[0], np.cumsum(np.bincount(asked.pair[:near], minlength=len(asked.first)))])
        places = {(2, s): (c, a, b) for s, c, _, a, b in asked.packed(asked.pair_shard, asked.first, asked.vocabulary, asked.parts, 0)}
        places |= {(3, s): (c, a + near, b + near) for s, c, _, a, b in asked.packed(asked.triple_shard[near:], asked.pair[near:], asked.hashes, asked.heavy, shards[1])}
        frequent_pair = asked.heavy > 1
        for r in right.to_pylist():
            kind, s = r["kind"], r["shard"]
            if kind == 1:
                count[asked.word_order[asked.word_cuts[s] : asked.word_cuts[s + 1]]] = unplanes(r["counts"], np.int64)
                continue
            contexts, a, b = places[kind, s]
            own, codes = np.frombuffer(r["weights"], np.uint8), np.frombuffer(r["codes"], np.uint8)
            weight, known = (weight2, known2) if kind == 2 else (weight3, known3)
            weight[contexts] += value_of(own)  # the parts of a frequent context add up
            known[contexts] |= own > 0
            if kind == 3:
                code3[a:b] = codes
                continue
            code2[a:b], code3[cuts3[a] : cuts3[b]] = codes, np.frombuffer(r["codes3"], np.uint8)
            alone = np.flatnonzero(~frequent_pair[a:b]) + a
            own3 = np.frombuffer(r["weights3"], np.uint8)[alone - a]
            weight3[alone], known3[alone] = value_of(own3), own3 > 0
        unigram = (count + 0.1) / (n + 0.1 * (v + 1))
        pair = value_of(code2) + np.where(known2, weight2, 1.0)[asked.first] * unigram[asked.second]
        token = pair[asked.pair_of]
        context = asked.pair_of[asked.inside - 1]
        token[asked.inside] = value_of(code3)[asked.triple_of] + np.where(known3, weight3, 1.0)[context] * token[asked.inside]
        total = lambda x: np.add.reduceat(x, asked.starts)
        ids = pa.array(np.frombuffer(row["doc_ids"], np.int64), pa.int64(), mask=np.frombuffer(row["no_id"], bool))
        columns = [asked.lengths, total((count > 0)[asked.tokens].astype(np.int64)), np.full(len(ids), n, np.int64), total(np.log10(unigram)[asked.tokens]), total(np.log10(np.minimum(token, 1.0)))]
        return pa.Table.from_arrays([ids, pa.array(asked.held), *map(pa.array, columns)], names)

    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, schema)


def score(docs: DataFrame, split_tokens: int = SPLIT_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Trains on the rows whose crc32(doc_id as text) mod 10 is not 0 and scores
    all, over whole texts.  Null text counts as empty: its only token is the
    end.  A null id counts as empty text for the split.  Repeated rows each
    train and get their row; an empty table gives none; other columns are not
    looked at.
    """
    blocks = materialise(encode(docs), "blocks")
    total = lambda column: F.coalesce(F.sum(column), F.lit(0))
    sizes = blocks.agg(total("train_tokens"), total(F.octet_length("vocabulary")), total(F.octet_length("tokens")), total("n_tokens")).first()
    shards = int(sizes[1]) // 8 // SHARD_KEYS + 1, int(sizes[2]) // SHARD_KEYS + 1
    split = frequent(blocks, int(sizes[3]), split_tokens)
    answered = materialise(answers(ask(blocks, shards, split)), "answers")
    v = answered.agg(total("distinct")).first()[0]
    return scores(blocks, answered, shards, split, int(sizes[0]), int(v))

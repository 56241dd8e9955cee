"""Best-fit packing of documents into fixed-length sequences, by linear grouping.

Packing only depends on lengths, and a length is at most the capacity, so the
corpus is a histogram of at most ``capacity`` counts.  On that histogram:

1. lengths of at least ``capacity / LARGE`` are sorted and cut into ``GROUPS``
   groups of equal cardinality, each length rounded up to its group's largest;
2. the configurations (multisets of rounded lengths that fit one sequence) are
   optimised by column generation: a small linear programme over the groups,
   priced by an integer knapsack;
3. actual lengths are substituted for the rounded ones, longest first;
4. what rounding down left over, then the small lengths, go best-fit into the
   remaining room, and into new sequences where none fits.

The plan says, for each length and range of ranks, the sequences and the place
in them: its size depends on the capacity, not on the corpus, so it is
broadcast.  Ranks come from per-partition counts of lengths, so no group of
equal lengths is ever gathered in a task.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.llm.common import materialise, text_of

CAPACITY = 2048
GROUPS = 24
#: Lengths of at least capacity / LARGE take part in the configurations.
LARGE = 8
END_ID = 0


# --- tokens ---------------------------------------------------------------


#: The splitting pattern that the byte-level pre-tokenizer of such files names by ``use_regex`` (a fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int], str]:
    """Ranks by bytes of a byte-level BPE file, the ids of its added tokens, and its splitting pattern.

    Such files spell each byte as a printable character: printable Latin-1
    bytes as themselves, the others as U+0100 onwards in order.  A file that
    asks for more than that is refused.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    tokens = spec.get("added_tokens", [])
    if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in tokens):
        raise ValueError(f"{path}: added tokens that take more than their own characters are not supported")
    split = spec.get("pre_tokenizer") or {}
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError(f"{path}: only byte-level splitting without a normalizer is supported")
    special = {t["content"]: t["id"] for t in tokens}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    return ranks, special, BYTE_LEVEL


def encoder(path: str):  # noqa: ANN201
    """text -> ids of the byte-level BPE in ``path``; added tokens that stand in the text have their own ids.

    ``tiktoken`` is several times faster than ``tokenizers`` and gives the same
    ids, but its splitting gives up on a million blanks and more in a row; such
    texts go to ``tokenizers``.
    """
    import tiktoken
    from tokenizers import Tokenizer

    ranks, special, pattern = byte_vocabulary(path)
    encoding, slow = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special), []

    def encode(text: str) -> list[int]:
        try:
            return encoding.encode(text, allowed_special="all")
        except ValueError:
            if not slow:
                slow.append(Tokenizer.from_file(path))
            return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: full ones, and a first one with the rest."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


# --- the plan -------------------------------------------------------------


def _price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best configuration for given values: unbounded integer knapsack by room."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    worth = [(int(s), float(v), i) for i, (s, v) in enumerate(zip(sizes, values, strict=True)) if v > 1e-9]
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        for s, v, i in worth:
            if s <= room and best[room - s] + v > best[room] + 1e-12:
                best[room], pick[room] = best[room - s] + v, i
    counts, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            counts[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """(configuration, times) of the linear programme that covers ``demand`` with the fewest sequences."""
    m = len(sizes)
    columns = [np.where(np.arange(m) == i, capacity // sizes[i], 0) for i in range(m)]
    basis = np.array(columns, dtype=float).T
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(m))
        value, fresh = _price(duals, sizes, capacity)
        if value <= 1 + 1e-7:
            break
        x = np.linalg.solve(basis, demand.astype(float))
        direction = np.linalg.solve(basis, fresh.astype(float))
        ratio = np.where(direction > 1e-9, np.maximum(x, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = fresh
    x = np.linalg.solve(basis, demand.astype(float))
    return [(basis[:, j].round().astype(np.int64), float(x[j])) for j in range(m)]


def linear_groups(counts: dict[int, int], groups: int = GROUPS) -> list[list[tuple[int, int]]]:
    """(length, count) lists of groups of equal cardinality, longest group first; a length may be in two groups."""
    total = sum(counts.values())
    per = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if room == 0:
                out.append([])
                room = per
            take = min(left, room)
            out[-1].append((length, take))
            left, room = left - take, room - take
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, rows, first sequence, offset), and the number of sequences.

    Documents of ``length`` with rank ``first rank + k`` go to sequence
    ``first sequence + k`` at ``offset``, for k below ``rows``.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    rank: dict[int, int] = defaultdict(int)
    open_runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs (first sequence, rows) of equal contents
    sequences = 0

    def put(length: int, first: int, n: int, room: int) -> None:
        """n documents of ``length`` into the run of sequences at ``first`` that have ``room`` left."""
        rows.append((length, rank[length], n, first, capacity - room))
        rank[length] += n
        open_runs[room - length].append((first, n))

    full = counts.get(capacity, 0)
    if full:
        put(capacity, 0, full, capacity)
        sequences = full
    left = {length: n for length, n in counts.items() if length < capacity and n > 0}
    large = {length: n for length, n in left.items() if length * LARGE >= capacity}
    if large:
        groups = linear_groups(large)
        sizes = np.array([g[0][0] for g in groups])
        demand = np.array([sum(n for _, n in g) for g in groups])
        stock = [list(g) for g in groups]
        for config, times in configurations(sizes, demand, capacity):
            n = int(times + 1e-9)
            if n <= 0:
                continue
            runs = [(sequences, n, capacity)]
            sequences += n
            for g in np.flatnonzero(config):
                for _ in range(int(config[g])):
                    after = []
                    for first, size, room in runs:
                        while size and stock[g]:
                            length, have = stock[g][0]
                            take = min(size, have)
                            rows.append((length, rank[length], take, first, capacity - room))
                            rank[length] += take
                            left[length] -= take
                            after.append((first, take, room - length))
                            first, size = first + take, size - take
                            if take == have:
                                stock[g].pop(0)
                            else:
                                stock[g][0] = (length, have - take)
                        if size:
                            after.append((first, size, room))
                    runs = after
            for first, size, room in runs:
                open_runs[room].append((first, size))
    rooms = sorted(r for r in open_runs if open_runs[r])
    for length in sorted((x for x in left if left[x] > 0), reverse=True):
        while left[length]:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                # new sequences, filled with as many of this length as fit before anything else
                each = capacity // length
                n = -(-left[length] // each)
                open_runs[capacity].append((sequences, n))
                rooms = sorted({*rooms, capacity})
                sequences += n
                continue
            room = rooms[at]
            first, size = open_runs[room].pop()
            if not open_runs[room]:
                rooms.pop(at)
            take = min(size, left[length])
            put(length, first, take, room)
            left[length] -= take
            if take < size:
                open_runs[room].append((first + take, size - take))
                if room not in rooms:
                    rooms = sorted({*rooms, room})
            if (rest := room - length) not in rooms:
                rooms = sorted({*rooms, rest})
    return rows, sequences


# --- the operator ---------------------------------------------------------


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces, with each piece's partition and its rank in it."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(tokenizer), defaultdict(int)
        part = TaskContext.get().partitionId()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows, kept = [], []
                for ident, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = np.array([*encode(text), END_ID], dtype="<u4")
                    for k, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                        piece = ids[start : start + length]
                        rows.append((ident, k, start, length, zlib.crc32(piece.tobytes()), part, seen[length]))
                        seen[length] += 1
                        if keep_ids:
                            kept.append(piece.astype(np.int32))
                if rows:
                    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    columns += [pa.array(kept, pa.list_(pa.int32()))] if keep_ids else []
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` ids.

    Null text counts as empty: such a document is its end id alone.  Documents
    longer than the capacity are cut into full pieces after a first one with
    the rest.  Repeated rows are packed as often as they occur; an empty table
    gives none.  Returns doc_id, piece, start, length, ids_crc32, sequence_id,
    offset (and ids).
    """
    spark = docs.sparkSession
    # written once: the ranks below must not move when a lost task runs again
    cut = materialise(pieces(docs, tokenizer, capacity, keep_ids), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    base = by_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = plan(counts, capacity)
    planned = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "length long, first_rank long, n long, first_sequence long, offset long")
    ranked = cut.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("local"))
    # few ranges a length: an array lookup keeps the join an equi-join on a broadcast of bounded size
    ranges = planned.groupBy(F.col("length").alias("plan_length")).agg(F.sort_array(F.collect_list(F.struct("first_rank", "n", "first_sequence", "offset"))).alias("ranges"))
    hit = F.element_at(F.filter("ranges", lambda r: (r["first_rank"] <= F.col("rank")) & (F.col("rank") < r["first_rank"] + r["n"])), 1)
    out = ranked.join(F.broadcast(ranges), ranked["length"] == ranges["plan_length"]).withColumn("hit", hit)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", (F.col("hit.first_sequence") + F.col("rank") - F.col("hit.first_rank")).alias("sequence_id"), F.col("hit.offset").alias("offset")]
    return out.select(*columns, *(["ids"] if keep_ids else []))

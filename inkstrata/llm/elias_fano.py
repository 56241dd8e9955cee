"""Elias-Fano sequences and the n-gram trie made of them, in compact memory-mapped levels.

A monotone sequence keeps the low bits of each value packed side by side and
the high bits as unary gaps.  Reading goes through arrays of queries at once.
A level is one run of bytes in an anonymous memory map: no local file.
"""

from __future__ import annotations

import mmap
from dataclasses import dataclass

import numpy as np

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(axis=1).astype(np.int64)
#: Place of the k-th zero bit of a byte (8 where it has fewer).
_NTH_ZERO = np.full((256, 9), 8, dtype=np.int64)
for _byte in range(256):
    _at = np.flatnonzero(_BITS[_byte] == 0)
    _NTH_ZERO[_byte, : len(_at)] = _at


class EliasFano:
    """A non-decreasing sequence of ``n`` integers below 2**63."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        zeros = 8 - _ONES[np.asarray(high)]
        self.zeros_before = np.concatenate([[0], np.cumsum(zeros)])

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if n == 0:
            return cls(0, 0, np.zeros(17, np.uint8), np.zeros(1, np.uint8))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, count=max(low_bits, 1), bitorder="little")[:, :low_bits]
        low = np.concatenate([np.packbits(bits.ravel(), bitorder="little"), np.zeros(17, np.uint8)])
        top = (values >> np.uint64(low_bits)).astype(np.int64)
        unary = np.zeros(int(top[-1]) + n + 2, np.uint8)
        unary[top + np.arange(n)] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"))

    def _lows(self, at: np.ndarray) -> np.ndarray:
        first = at * self.low_bits
        byte, shift = first >> 3, (first & 7).astype(np.uint64)
        low = np.ascontiguousarray(self.low)
        word = np.ndarray((len(low) - 8,), "<u8", low, strides=(1,))[byte] >> shift
        spill = self.low[byte + 8].astype(np.uint64)
        word |= np.where(shift > 0, spill << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return word & np.uint64((1 << self.low_bits) - 1)

    def bucket_start(self, top: np.ndarray) -> np.ndarray:
        """How many values have high bits below ``top``: the place of the unary code's zero number ``top`` - 1, less the zeros."""
        want = np.minimum(np.asarray(top, dtype=np.int64), int(self.zeros_before[-1])) - 1
        byte = np.searchsorted(self.zeros_before, np.maximum(want, 0), side="right") - 1
        byte = np.minimum(byte, len(self.high) - 1)
        place = byte * 8 + _NTH_ZERO[self.high[byte], np.minimum(np.maximum(want, 0) - self.zeros_before[byte], 8)]
        return np.where(want < 0, 0, np.minimum(place - want, self.n))

    def successor(self, values: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """For each value, the first place within [start, end) that is not below it, else ``end``."""
        values = np.asarray(values, dtype=np.uint64)
        top = np.minimum(values >> np.uint64(self.low_bits), np.uint64(1 << 62)).astype(np.int64)
        low = np.asarray(values & np.uint64((1 << self.low_bits) - 1))
        a, b = self.bucket_start(top), self.bucket_start(top + 1)
        if start is not None:
            a, b = np.clip(a, start, end), np.clip(b, start, end)
        while True:  # binary search inside the bucket, for all values at once
            live = a < b
            if not live.any():
                return a
            mid = (a + b) >> 1
            less = np.zeros(len(a), bool)
            less[live] = self._lows(mid[live]) < low[live]
            a = np.where(live & less, mid + 1, a)
            b = np.where(live & ~less, mid, b)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at some places."""
        at = np.asarray(at, dtype=np.int64)
        ones = np.arange(len(self.high) + 1) * 8 - self.zeros_before
        byte = np.searchsorted(ones, at, side="right") - 1
        nth = at - ones[byte]
        place = _NTH_ZERO[255 - np.asarray(self.high)[byte], np.minimum(nth, 8)]
        return ((byte * 8 + place - at).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(at)

    def contains(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the value at each place (the successor's) is the value itself; places past the end hold none."""
        found = np.zeros(len(at), bool)
        inside = np.asarray(at) < self.n
        found[inside] = self.get(np.asarray(at)[inside]) == np.asarray(values, dtype=np.uint64)[inside]
        return found

    def dump(self) -> bytes:
        return np.array([self.n, self.low_bits, len(self.low), len(self.high)], np.int64).tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def load(cls, data: np.ndarray) -> tuple[EliasFano, int]:
        n, low_bits, a, b = (int(x) for x in np.asarray(data[:32]).view(np.int64))
        return cls(n, low_bits, data[32 : 32 + a], data[32 + a : 32 + a + b]), 32 + a + b


KEY_BITS = 32
#: Quantised log10 of a probability or weight: code 0 is "not there", code c stands for -(c - 1) * STEP.
STEP = 0.04
#: Count taken off every n-gram that was seen; what is taken off goes to the shorter n-gram.
DISCOUNT = 0.75


def quantised(x: np.ndarray) -> np.ndarray:
    """Codes of numbers above 0 and at most 1 (0 itself takes the least code there is)."""
    with np.errstate(divide="ignore"):
        return (np.clip(np.rint(-np.log10(x) / STEP), 0, 254) + 1).astype(np.uint8)


def value_of(codes: np.ndarray) -> np.ndarray:
    """Numbers that codes stand for; 0 where there is none."""
    return np.where(codes == 0, 0.0, 10.0 ** (-(np.asarray(codes, dtype=np.float64) - 1) * STEP))


@dataclass
class Level:
    """Continuations of the entries of the level above: monotone pointers into one monotone sequence of (entry number, key)."""

    pointers: EliasFano
    children: EliasFano
    #: Smoothed probability of each continuation: its discounted share of its context.
    codes: np.ndarray
    #: Weight of the shorter n-gram for each entry of the level above.
    weights: np.ndarray

    @classmethod
    def build(cls, totals: np.ndarray, of: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Level:
        """``totals`` of the entries above; continuations (entry above, key, count) in order, each once."""
        kinds = np.bincount(of, minlength=len(totals))
        pointers = EliasFano.build(np.concatenate([[0], np.cumsum(kinds)]))
        share = (counts - DISCOUNT) / totals[of] if len(of) else np.zeros(0)
        return cls(pointers, EliasFano.build((of.astype(np.uint64) << np.uint64(KEY_BITS)) | keys), quantised(share), quantised(DISCOUNT * kinds / np.maximum(totals, 1)))

    def find(self, numbers: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Numbers of continuations by context-relative successor search; -1 where the context or the continuation is not there."""
        out = np.full(len(numbers), -1, np.int64)
        known = np.flatnonzero(numbers >= 0)
        if len(known) and self.children.n:
            number = numbers[known]
            start, end = (self.pointers.get(number + k).astype(np.int64) for k in (0, 1))
            want = (number.astype(np.uint64) << np.uint64(KEY_BITS)) | keys[known]
            at = self.children.successor(want, start, end)
            hit = (at < end) & self.children.contains(want, np.where(at < end, at, self.children.n))
            out[known[hit]] = at[hit]
        return out

    def mapped(self) -> Level:
        return Level(*(EliasFano.load(_map(x.dump()))[0] for x in (self.pointers, self.children)), _map(self.codes.tobytes()), _map(self.weights.tobytes()))


@dataclass
class NgramTrie:
    """Contexts, the words that follow them, and the words that follow those pairs, with quantised smoothed probabilities.

    A word's key is ``KEY_BITS`` of its hash.
    """

    contexts: EliasFano
    pairs: Level
    triples: Level

    @classmethod
    def build(cls, contexts: np.ndarray, totals: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], triples: tuple[np.ndarray, np.ndarray, np.ndarray]) -> NgramTrie:
        """Sorted distinct ``contexts`` with their ``totals``; ``pairs`` and ``triples`` as (number in the level above, key, count), sorted."""
        return cls(EliasFano.build(contexts), Level.build(totals, *pairs), Level.build(pairs[2], *triples))

    def find(self, contexts: np.ndarray) -> np.ndarray:
        """Context numbers; -1 where there is none."""
        at = self.contexts.successor(contexts)
        return np.where(self.contexts.contains(contexts, at), at, -1)

    def mapped(self) -> NgramTrie:
        """The same trie over memory-mapped levels."""
        return NgramTrie(EliasFano.load(_map(self.contexts.dump()))[0], self.pairs.mapped(), self.triples.mapped())


def codes_at(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Codes by number; 0 where the number is -1."""
    return np.where(at >= 0, np.asarray(codes)[np.maximum(at, 0)], 0).astype(np.uint8) if len(codes) else np.zeros(len(at), np.uint8)


def _map(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint8)
    held = mmap.mmap(-1, len(data))
    held.write(data)
    return np.frombuffer(held, np.uint8)

"""Codes of words, kept across Arrow batches without a Python object a word.

A batch's words are told apart by Arrow's dictionary encoding. Each distinct word's 128-bit hash is looked up in an
open-addressing table; the words that it lacks are encoded in one call. The codes are one binary array, from which the
batch's are taken in the order of its words.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from tidemark.llm.bytehash import SPACE, Prefix
from tidemark.llm.shared import buffer_of

#: Encodes words: bytes of all codes, and where each ends.
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values from their bytes and their ends, which begin with 0."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def blank_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs between ASCII blanks of a string column, and the number of runs before each row's end, which begins with 0."""
    data, ends = buffer_of(column)
    full = ~SPACE[data]
    opens = full.copy()
    opens[1:] &= ~full[:-1]
    inner = ends[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    opens[inner] |= full[inner]
    at = np.flatnonzero(opens)
    packed = data[full]
    before = np.cumsum(full, dtype=np.int32)
    return binaries(packed, np.append(before[at] - 1, len(packed))), np.searchsorted(at, ends)


class Kept:
    """Codes of at most about ``most`` words (more only while one batch has more); begins anew when it is full."""

    def __init__(self, encode: Encode, most: int):
        self.encode, self.most = encode, most
        self._empty(0)

    def _empty(self, need: int) -> None:
        slots = 1 << 16
        while slots < 2 * max(self.most, need):
            slots *= 2
        self.first, self.second, self.place = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self.n, self.data, self.ends = 0, np.zeros(1 << 16, np.uint8), np.zeros(1 << 12, np.int64)

    def _find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = np.full(len(one), -1, np.int32)
        mask = len(self.place) - 1
        todo, slot = np.arange(len(one)), (one & np.uint64(mask)).astype(np.int64)
        while len(todo):
            held = self.place[slot]
            hit = (held >= 0) & (self.first[slot] == one[todo]) & (self.second[slot] == two[todo])
            out[todo[hit]] = held[hit]
            go = (held >= 0) & ~hit
            todo, slot = todo[go], (slot[go] + 1) & mask
        return out

    def _add(self, one: np.ndarray, two: np.ndarray, data: np.ndarray, ends: np.ndarray) -> None:
        """Words that the table lacks, each once."""
        size = int(self.ends[self.n])
        while size + len(data) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        while self.n + len(one) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.data[size : size + len(data)] = data
        self.ends[self.n + 1 : self.n + 1 + len(one)] = size + ends
        mask = len(self.place) - 1
        todo, slot = np.arange(len(one)), (one & np.uint64(mask)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.place[slot] < 0)
            self.place[slot[free]] = self.n + todo[free]  # of several words for one slot the last stays
            own = self.place[slot] == self.n + todo
            self.first[slot[own]], self.second[slot[own]] = one[todo[own]], two[todo[own]]
            todo, slot = todo[~own], (slot[~own] + 1) & mask
        self.n += len(one)

    def codes(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the codes of all words in order, and where each word's end, which begin with 0."""
        known = words.dictionary_encode()
        own = known.dictionary
        data, ends = buffer_of(own)
        one, two = (Prefix(data, k).of(ends[:-1], ends[1:]) for k in range(2))
        place = self._find(one, two)
        new = np.flatnonzero(place < 0)
        if self.n + len(new) > len(self.place) // 2:
            self._empty(len(own))
            new = np.arange(len(own))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            codes, stops = self.encode([w.decode(errors="replace") for w in own.take(pa.array(part)).to_pylist()])
            place[part] = self.n + np.arange(len(part))
            self._add(one[part], two[part], codes, stops)
        held = binaries(self.data[: int(self.ends[self.n])], self.ends[: self.n + 1])
        return buffer_of(held.take(pa.array(place[known.indices.to_numpy()]))) if len(words) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))

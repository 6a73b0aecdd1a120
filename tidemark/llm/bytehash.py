"""Hashes of many substrings of one byte buffer at once, in numpy.

Each byte is replaced by a random 64-bit number and weighted by the power of an odd base that belongs to its place.
Prefix sums modulo 2**64 then give the hash of any range in constant time; a final mixing step spreads the bits.
"""

from __future__ import annotations

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_LOW = 1 << 12
_BLOCK = 64 * _LOW
LONG = 4 << 20  # bytes of a text beyond which it is gone through in pieces


def _numbers(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, np.uint64)


_BYTES = tuple(_numbers(1000 + k, 256) for k in range(2))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def _steps(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


#: Powers 0 to _LOW - 1 of each base and of its inverse; higher ones are products of these and of powers of base**_LOW.
_POWERS = tuple(tuple(_steps(b, _LOW) for b in (base, pow(base, -1, 1 << 64))) for base in _BASES)


def _high(which: int, inverse: bool, n: int) -> np.ndarray:
    """Powers of base**_LOW that reach place ``n``."""
    base = _BASES[which]
    return _steps(pow(pow(base, -1, 1 << 64) if inverse else base, _LOW, 1 << 64), n // _LOW + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes unchanged."""
    return _LOWER[data]


class Prefix:
    """Prefix sums of a buffer; ``of(starts, ends)`` hashes ranges."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.which, n = which, len(data)
        up, self.down = _high(which, False, n), _high(which, True, n)
        self.sums = np.zeros(n + 1, np.uint64)
        for at in range(0, n, _BLOCK):
            part = data[at : at + _BLOCK]
            high = up[at // _LOW : at // _LOW + -(-len(part) // _LOW)]
            weight = (high[:, None] * _POWERS[which][0]).ravel()[: len(part)]
            weight *= _BYTES[which][part]
            np.cumsum(weight, out=weight)
            np.add(weight, self.sums[at], out=self.sums[at + 1 : at + 1 + len(part)])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = self.sums[ends] - self.sums[starts]
        out *= self.down[starts >> 12]
        out *= _POWERS[self.which][1][starts & (_LOW - 1)]
        out += (ends - starts).astype(np.uint64)
        return mix(out)


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of all maximal runs of bytes other than blank, tab and line ends; rows end at ``ends``."""
    full = ~SPACE[data]
    first, last = full.copy(), full.copy()
    first[1:] &= ~full[:-1]
    last[:-1] &= ~full[1:]
    inner = ends[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] |= full[inner]
    last[inner - 1] |= full[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(ends, starts, "right") - 1


def pieces(data: np.ndarray, ends: np.ndarray, mark: np.ndarray = SPACE) -> list[tuple[int, int]]:
    """Bounds of parts of the buffer that are worked on at once: all of it, or for one long row parts of about ``LONG`` bytes
    that end before a marked byte (without one, later)."""
    if len(ends) != 2 or len(data) <= LONG:
        return [(0, len(data))]
    out, at = [], 0
    while at < len(data):
        to = at + LONG
        while to < len(data):
            found = np.flatnonzero(mark[data[to : to + LONG]])
            if len(found):
                to += int(found[0])
                break
            to += LONG
        out.append((at, min(to, len(data))))
        at = out[-1][1]
    return out


def word_hashes(low: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word."""
    parts = pieces(low, ends)
    if len(parts) == 1:
        starts, stops, rows = words(low, ends)
        return Prefix(low).of(starts, stops) if len(starts) else np.zeros(0, np.uint64), rows
    found = []
    for a, b in parts:
        part = low[a:b]
        starts, stops, _ = words(part, np.array([0, b - a]))
        found.append(Prefix(part).of(starts, stops))
    each = np.concatenate(found)
    return each, np.zeros(len(each), np.int64)


def shingles(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``size`` words; a row of fewer words gives one of all its words."""
    each, rows = word_hashes(lowered(data), ends)
    if not len(each):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    odd = _numbers(77, size) | np.uint64(1)
    count = np.bincount(rows, minlength=len(ends) - 1)
    found, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(each) >= size:
        sums = np.zeros(len(each) - size + 1, np.uint64)
        for k in range(size):
            sums += each[k : k + len(sums)] * odd[k]
        whole = rows[: len(sums)] == rows[size - 1 :]
        found, owner = mix(sums[whole]), rows[: len(sums)][whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        at = np.searchsorted(rows, short)
        sums = np.full(len(short), 1, np.uint64) + count[short].astype(np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            sums[has] += each[at[has] + k] * odd[k]
        found, owner = np.concatenate([found, mix(sums)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    return found, owner


def distinct(found: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, hash) once, sorted by row, then hash."""
    if len(owner) and owner[0] == owner[-1]:
        found = np.unique(found)
        return found, np.full(len(found), owner[0])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], owner[new]

"""Whole-block text kernels in numpy that the Python-side operators share.

Arrow hands a string column over as one byte buffer with offsets. The kernels work on
blocks of such buffers (about ``BLOCK_BYTES`` each, a longer text alone), so the cost of a
numpy call is spread over a million bytes and no Python string is made for a word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

OTHER, LETTER, NUMBER, SPACE, UNASSIGNED = 0, 1, 2, 3, 4
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows that together hold about ``size`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> U64(30))) * _MIX1
    h = (h ^ (h >> U64(27))) * _MIX2
    return h ^ (h >> U64(31))


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, BLOCK_BYTES + 4096)
            inverse = pow(_MULT, -1, 1 << 64)
            for name, m in (("up", _MULT), ("down", inverse)):
                a = np.full(n, U64(m))
                a[0] = U64(1)
                setattr(self, name, np.multiply.accumulate(a))
        return self.up, self.down


POWERS = _Powers()


def rolling_prefix(data: np.ndarray) -> np.ndarray:
    """P with P[i] the sum of (byte + 1) * m**k over k < i, modulo 2**64: for rolling hashes that choose places, never for names."""
    up, _ = POWERS.get(len(data) + 1)
    out = np.empty(len(data) + 1, U64)
    out[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


#: Two primes and a multiplier for each. (Modulo a power of two, strings of the Thue-Morse kind meet whatever the multiplier.)
_FIELDS = ((2**31 - 1, 1_103_515_249), (2**31 - 19, 1_664_525_917))
_FIELD_POWERS = [np.ones(1, U64) for _ in _FIELDS]


def _field_powers(n: int) -> list[np.ndarray]:
    for k, (p, m) in enumerate(_FIELDS):
        a = _FIELD_POWERS[k]
        while len(a) < n:
            a = np.concatenate([a, a * U64(pow(m, len(a), p)) % U64(p)])
        _FIELD_POWERS[k] = a
    return _FIELD_POWERS


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes and length, whatever its place; never 0. Spans are not empty, ordered, and lie apart.

    Polynomials over two prime fields, mixed: unequal spans of n bytes meet with a probability of about (n / 2**31)**2.
    """
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    total, longest = int(lengths.sum()), int(lengths.max())
    first = np.cumsum(lengths) - lengths
    place = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    if total == int(ends[-1]) - int(starts[0]):
        value = data[starts[0] : ends[-1]]
    else:
        value = data[place + np.repeat(starts, lengths)]
    value = value.astype(U64) + U64(1)
    h = lengths.astype(U64) * U64(0xD6E8FEB86659FD93)
    for k, ((p, _), powers) in enumerate(zip(_FIELDS, _field_powers(longest))):
        terms = value * powers[place]
        if longest >= 1 << 24:
            terms %= U64(p)
        part = np.add.reduceat(terms, first) % U64(p)
        h ^= part << U64(32) if k else part
        h = mix(h)
    return np.where(h == 0, U64(1), h)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of each code point: letter, number, white space, unassigned or other."""
    table = np.full(0x110000, UNASSIGNED, np.uint8)
    table[0xF0000:0xFFFFE] = table[0x100000:0x10FFFE] = OTHER  # private use
    kinds = {"L": LETTER, "N": NUMBER}
    for c in (*range(0x33480), *range(0xE0000, 0xE01F0)):  # nothing is assigned elsewhere
        kind = unicodedata.category(chr(c))
        table[c] = UNASSIGNED if kind == "Cn" else kinds.get(kind[0], OTHER)
    table[_WHITE] = SPACE
    return table


def char_classes(data: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Places of the characters (None: each byte is one) and their classes."""
    table = class_table()
    if not len(data) or data.max() < 0x80:
        return None, table[:128][data]
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    return starts, table[code_points(data, starts)]


def code_points(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Code points of the UTF-8 characters at ``starts``."""
    lead = data[starts]
    cp = lead.astype(np.int32)
    for k, (low, mask) in enumerate(((0xC0, 0x1F), (0xE0, 0x0F), (0xF0, 0x07)), 1):
        at = np.flatnonzero((lead >= low) & (lead < (0xE0, 0xF0, 0xFF)[k - 1]))
        if len(at):
            v = lead[at].astype(np.int32) & mask
            for j in range(1, k + 1):
                v = (v << 6) | (data[starts[at] + j] & 0x3F)
            cp[at] = v
    return cp


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges starts[i] .. starts[i] + lengths[i]."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class HashIndex:
    """Open-addressing map of non-zero 64-bit keys to 0, 1, 2, ... in order of arrival."""

    def __init__(self, bits: int = 21) -> None:
        self.bits, self.limit = bits, (1 << bits) * 6 // 10
        self.clear()

    def clear(self) -> None:
        self.keys, self.vals, self.n = np.zeros(1 << self.bits, U64), np.zeros(1 << self.bits, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where it is not there."""
        mask = (1 << self.bits) - 1
        slot = (h >> U64(64 - self.bits)).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == h, self.vals[slot], -1)
        todo = np.flatnonzero((got != h) & (got != 0))
        at = slot[todo]
        while len(todo):
            at = (at + 1) & mask
            got = self.keys[at]
            hit = got == h[todo]
            out[todo[hit]] = self.vals[at[hit]]
            on = ~hit & (got != 0)
            todo, at = todo[on], at[on]
        return out

    def add(self, fresh: np.ndarray) -> np.ndarray:
        """Numbers for keys that are distinct and not there yet."""
        mask = (1 << self.bits) - 1
        ids = np.arange(self.n, self.n + len(fresh), dtype=np.int32)
        at, todo = (fresh >> U64(64 - self.bits)).astype(np.int64), np.arange(len(fresh))
        while len(todo):
            free = self.keys[at] == 0
            self.keys[at[free]] = fresh[todo[free]]  # of several for one slot the last stays
            won = free & (self.keys[at] == fresh[todo])
            self.vals[at[won]] = ids[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & mask
        self.n += len(fresh)
        return ids

"""Word hashes of many texts at once, on their UTF-8 bytes.

A word's hash is a polynomial of its bytes modulo 2^64, taken from prefix sums, then
mixed. Words and documents keep their order; nothing is looked up word by word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Powers are products of one of the first 2^16 and one of their 2^16th steps, so few are kept.
_LOW_BITS = 16
_powers: dict[int, np.ndarray] = {}


def _steps(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    held = np.ones(1, np.uint64)
    while len(held) < n:
        held = np.concatenate([held, held * np.uint64(pow(base, len(held), 1 << 64))])
    return held[:n]


def _low(base: int) -> np.ndarray:
    if base not in _powers:
        _powers[base] = _steps(base, 1 << _LOW_BITS)
    return _powers[base]


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    if n <= 1 << _LOW_BITS:
        return _low(base)[:n]
    high = _steps(pow(base, 1 << _LOW_BITS, 1 << 64), (n >> _LOW_BITS) + 1)
    return np.multiply.outer(high, _low(base)).ravel()[:n]


def _power_at(base: int, places: np.ndarray) -> np.ndarray:
    """base to the power of each of the places, modulo 2^64."""
    if not len(places):
        return np.zeros(0, np.uint64)
    high = _steps(pow(base, 1 << _LOW_BITS, 1 << 64), (int(places.max()) >> _LOW_BITS) + 1)
    return high[places >> _LOW_BITS] * _low(base)[places & ((1 << _LOW_BITS) - 1)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of a slice of texts: ``offsets`` per text, byte ``starts``/``ends``, ``hashes``."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_binary())
        buffers = texts.buffers()
        at = np.frombuffer(buffers[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        low, high = int(at[0]), int(at[-1])
        data = np.frombuffer(buffers[2], np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8)
        self.data = _LOWER[data] if lower else data
        at = at - low
        self.text_begins = at
        word = ~_IS_SPACE[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True  # a text's first byte follows nothing
        before = np.zeros(len(data), bool)
        before[1:] = word[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = word[1:]
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.offsets = np.searchsorted(self.starts, at)
        sums = np.zeros(len(data) + 1, np.uint64)
        own = sums[1:]
        own += self.data
        own += np.uint64(1)
        own *= _power(_BASE, len(data))
        np.cumsum(own, out=own)
        h = (sums[self.ends] - sums[self.starts]) * _power_at(pow(_BASE, -1, 1 << 64), self.starts)
        self.hashes = mix(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()

    def places(self) -> tuple[memoryview, np.ndarray, np.ndarray]:
        """Bytes, and where words begin and end in them, for those who keep many texts and no hashes."""
        kind = np.int32 if len(self.data) < 1 << 31 else np.int64
        return memoryview(self.data), self.starts.astype(kind), self.ends.astype(kind)

    def words_at(self, places: np.ndarray) -> list[bytes]:
        data = self.data.tobytes()
        return [data[a:b] for a, b in zip(self.starts[places].tolist(), self.ends[places].tolist(), strict=True)]


def windows(hashes: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """A hash of every run of ``size`` consecutive words, in order."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    base = (0xA0761D6478BD642F + 2 * seed * 0x8EBC6AF09C88C6E3) & _MASK | 1
    values = mix(hashes ^ np.uint64(seed))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(values * _power(base, len(hashes)), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * _power(pow(base, -1, 1 << 64), n))


class Values(NamedTuple):
    """Byte strings: a stretch of ``flat`` each; the size -1 stands for None."""

    flat: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray


class Memo:
    """Values of words, computed once per distinct word a worker meets.

    ``compute(words)`` gives one ``bytes`` value or None per word (or pair of word and ``more``). Keys are a sorted array and
    values lie in a row, so a word takes about 50 bytes. The store starts anew beyond ``limit`` words, so memory is bounded;
    values never depend on what is stored.
    """

    def __init__(self, compute, limit: int = 300_000):
        self.compute, self.limit = compute, limit
        self._start()

    def _start(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begins, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint8)

    def of(self, words: Words, keys: np.ndarray, more: np.ndarray | None = None) -> tuple[Values, np.ndarray]:
        """Values of the distinct keys, and for each word which of them it has."""
        # Distinct keys by a hash table, in the order in which they come.
        coded = pa.array(keys).dictionary_encode()
        inverse = coded.indices.to_numpy()
        listed = coded.dictionary.to_numpy()
        if len(self.keys) > self.limit:
            self._start()
        new = ~self._held(listed)
        if new.any():
            first = np.empty(len(listed), np.int64)
            first[inverse[::-1]] = np.arange(len(keys) - 1, -1, -1)  # the last to be written is the first place
            at = first[new]
            asked = words.words_at(at)
            if more is not None:
                asked = list(zip(asked, more[at].tolist(), strict=True))
            self._add(listed[new], self.compute(asked))
        found = np.searchsorted(self.keys, listed)
        return Values(self.flat, self.begins[found], self.sizes[found]), inverse

    def _held(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        at = np.searchsorted(self.keys, keys)
        return self.keys[np.minimum(at, len(self.keys) - 1)] == keys

    def _add(self, keys: np.ndarray, values: list[bytes | None]) -> None:
        sizes = np.fromiter((-1 if v is None else len(v) for v in values), np.int64, len(values))
        held = np.maximum(sizes, 0)
        begins = len(self.flat) + np.cumsum(held) - held
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join([v or b"" for v in values]), np.uint8)])
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.begins = np.insert(self.begins, at, begins[order])
        self.sizes = np.insert(self.sizes, at, sizes[order])


def laid_out(values: Values, inverse: np.ndarray, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words' values in word order as ``width``-byte integers, and each word's first place; None has none."""
    flat = values.flat.view(f"<u{width}")
    sizes = np.maximum(values.sizes, 0) // width
    begins = values.begins // width
    each = sizes[inverse]
    ends = np.concatenate([[0], np.cumsum(each)])
    at = np.repeat(begins[inverse] - ends[:-1], each)
    return flat[at + np.arange(ends[-1])], ends

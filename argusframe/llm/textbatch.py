"""Words, lines and window fingerprints of many texts at once, in numpy.

Used inside ``mapInArrow`` tasks. A batch of texts is taken in slices of about a
megabyte (a longer text alone makes a slice), so memory stays small whatever the
size of a batch. Words are runs of bytes other than space and tab to carriage
return; a fingerprint is 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(32))


def _power(n: int, inverse: bool) -> np.ndarray:
    """The first n powers of the base (or of its inverse) modulo 2**64."""
    key = "inverse" if inverse else "base"
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), _BASE_INVERSE if inverse else _BASE, np.uint64)
        steps[0] = 1
        full = np.multiply.accumulate(steps)
        if n > 4 * SLICE_BYTES:
            return full[:n]
        _powers[key] = full
    return _powers[key][:n]


class Slice:
    """Texts ``first`` to ``first + n`` of a batch as one run of bytes with the places of its words.

    ``data``: bytes, ``bounds``: start of each text and the end, ``starts``/``ends``: bytes of words,
    ``word_bounds``: first word of each text and the end.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int, lower: bool, apart: np.ndarray = _SPACE):
        self.first, self.n, self.bounds = first, len(bounds) - 1, bounds
        self.data = _LOWER[data] if lower else data
        inside = ~apart[data]
        heads = bounds[:-1][bounds[:-1] < bounds[1:]]
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        start[heads] = inside[heads]
        end[:-1] &= ~inside[1:]
        tails = heads[1:] - 1
        end[tails] = inside[tails]
        self.inside = inside
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.word_bounds = np.searchsorted(self.starts, bounds)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Fingerprint of each span of bytes."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        n = len(self.data)
        if not hasattr(self, "sums"):
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE_VALUE[self.data] * _power(n, False), out=self.sums[1:])
        raw = (self.sums[ends] - self.sums[starts]) * _power(n + 1, True)[starts]
        return mix(raw + (ends - starts).astype(np.uint64))

    @property
    def words(self) -> np.ndarray:
        if not hasattr(self, "_words"):
            self._words = self.hashes(self.starts, self.ends)
        return self._words

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each line."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.bounds[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.bounds[1:], breaks]), kind="stable")
        return starts, ends, np.repeat(np.arange(self.n), np.bincount(self.text_of(breaks), minlength=self.n) + 1)

    def text_of(self, places: np.ndarray) -> np.ndarray:
        """Number of the text that holds each byte."""
        return np.searchsorted(self.bounds, places, side="right") - 1

    def counts(self, mask: np.ndarray) -> np.ndarray:
        """True bytes of ``mask`` by text."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def fold(x: np.ndarray, step: int, salt: int) -> np.ndarray:
    """Fingerprints of windows twice as long: window i is windows i and i + step of x."""
    return mix(x[:-step] * np.uint64(2 * salt + 0x9E3779B97F4A7C15) + x[step:]) if len(x) > step else np.zeros(0, np.uint64)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of each run of ``size`` words, in order; texts are not told apart here."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xFF51AFD7ED558CCD) + words[k:k + n]
    return mix(out)


def slices(texts: pa.Array, lower: bool = False, apart: np.ndarray = _SPACE) -> Iterator[Slice]:
    """A column of texts (null: empty) in slices, in order. ``apart``: which bytes stand between words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield Slice(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], at, lower, apart)
        at = to


def as_long(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as the same bits in Spark's signed type."""
    return pa.array(x.view(np.int64))

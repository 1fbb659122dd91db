"""Whole-batch word splitting and hashing with numpy.

The texts of an Arrow batch lie in one byte buffer, so words, their hashes and
their n-grams are found for all texts of the batch at once.  Texts are handled in
chunks of bounded bytes; a text longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]
_powers = _inverses = np.ones(1, np.uint64)


class Words(NamedTuple):
    """Words of some consecutive texts: `first` and `last` bound the texts, `bounds` the words of each."""

    first: int
    last: int
    hashes: np.ndarray
    bounds: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    global _powers, _inverses
    if len(_powers) < n:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers, _inverses = both
    return _powers[:n], _inverses[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each word's bytes, by sums of powers over blocks of whole words."""
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + block, "right")))
        a, b = starts[first:last] - base, ends[first:last] - base
        n = int(b[-1])
        power, inverse = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data[base : base + n].astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        out[first:last] = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(_STEP[0]))
        first = last
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def word_chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES, blank: np.ndarray = SPACE) -> Iterator[Words]:
    """Words of every text after lower-casing A-Z: by default `[^\\x20\\x09-\\x0D]+`, else runs of bytes that `blank` hasn't."""
    data, at = utf8(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + chunk_bytes, "right")) - 1)
        base = at[first]
        part = LOWER[data[base : at[last]]]
        edges = at[first : last + 1] - base
        n = len(part)
        space = blank[part]
        cut = np.zeros(n + 1, bool)
        cut[edges] = True
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:] = space[:-1]
        after[:-1] = space[1:]
        starts = np.flatnonzero(~space & (before | cut[:-1]))
        ends = np.flatnonzero(~space & (after | cut[1:])) + 1
        hashes = word_hashes(part, starts, ends)
        yield Words(first, last, hashes, np.searchsorted(starts, edges), part, starts, ends)
        first = last


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number within the chunk, hash) of each text's distinct n-grams, ordered by both.

    A text with fewer than `size` words has its whole sequence as its one n-gram.
    """
    h, bounds = words.hashes, words.bounds
    counts = np.diff(bounds)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(h)) - bounds[text]
    left = counts[text] - place
    total = np.zeros(len(h), np.uint64)
    for k in range(size):
        inside = left[: len(h) - k] > k if k else slice(None)
        part = np.roll(h, -k)[: len(h) - k] * np.uint64(_STEP[k % 5] + 2 * (k // 5))
        if k:
            part = np.where(inside, part, np.uint64(0))
        total[: len(h) - k] += part
    short = counts[text] < size
    keep = (left >= size) | (short & (place == 0))
    value = mix(total[keep] + np.where(short[keep], counts[text[keep]], size).astype(np.uint64))
    text = text[keep]
    value = value.copy()
    cuts = np.searchsorted(text, np.arange(len(counts) + 1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return text[new], value[new]

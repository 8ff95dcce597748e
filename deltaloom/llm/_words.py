"""Word hashes of many texts at once, from the UTF-8 bytes of an Arrow array."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes that are worked on together, or one text if it is longer

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
#: Letters and digits of ASCII, and all bytes of other characters.
_in_word = np.zeros(256, dtype=bool)
_in_word[48:58] = _in_word[65:91] = _in_word[97:123] = _in_word[128:] = True
_of_byte = np.random.default_rng(2).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse modulo 2 ** 64 for i < n."""
    inverse = pow(_BASE, -1, 2**64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits each depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: index of the first, words in each, and a hash of each word.

    A word is a longest run of the characters above, A-Z as a-z; a null text has none.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK, "right")) - 1)
        bounds = ends[first : last + 1] - ends[first]
        yield first, *_of_bytes(data[ends[first] : ends[last]], bounds)
        first = last


def _of_bytes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(len(bounds) - 1, np.int64), np.zeros(0, np.uint64)
    inside = _in_word[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    before[cuts], after[cuts - 1] = False, False
    starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    power, inverse = _powers(1 << max(20, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_of_byte[_lower[data]] * power[: len(data)], out=sums[1:])
    hashes = mixed((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
    return np.diff(np.searchsorted(starts, bounds)), hashes


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total = total * np.uint64(_BASE) + words[j : j + n]
    return mixed(total)

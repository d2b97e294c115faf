"""Words of whole texts as 64-bit hashes, many texts at a time.

A word's hash is the sum over its bytes of ``value[byte] * key[place in the word]`` modulo 2**64, mixed. Values and keys are drawn once and
independent of each other from place to place, so that no exchange of letters, as between powers of one base, leaves the sum as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

CHUNK_BYTES = 1 << 19
BLOCK = 1 << 15
BYTE_VALUES = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes that part words. White space of ASCII; everything of ASCII but letters and digits.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


@lru_cache(maxsize=4)
def _keys(n: int) -> np.ndarray:
    """One odd key for each of the first ``n`` places of a word; more places leave the first ones as they are."""
    return np.random.PCG64(20240613).random_raw(n) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(data: bytes, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, byte at which it starts, byte at which it ends)."""
    codes = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(codes) + 2, dtype=np.int8)
    inside[1:-1] = ~separators[codes]
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    lengths = ends - starts
    sums = np.empty(len(starts), dtype=np.uint64)
    keys = _keys(1 << max(6, int(lengths.max(initial=0)).bit_length()))
    first = 0
    while first < len(starts):  # runs of words that stay in the processor's cache
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, side="right")))
        size = lengths[first:last]
        begin = np.cumsum(size) - size
        total = int(begin[-1] + size[-1])
        place = np.arange(total) - np.repeat(begin, size)
        spots = place + np.repeat(starts[first:last], size)
        sums[first:last] = np.add.reduceat(BYTE_VALUES[codes[spots]] * keys[place], begin)
        first = last
    return mixed(sums), starts, ends


def word_chunks(texts: list[str], separators: np.ndarray, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, number of texts, word hashes, word offsets of these texts) for runs of texts.

    A-Z count as a-z. A text is never cut, so the longest single text bounds the memory of a chunk.
    """
    begin = 0
    while begin < len(texts):
        parts, size, end = [], 0, begin
        while end < len(texts) and (not parts or size < chunk):
            parts.append(texts[end].encode("utf-8", "surrogatepass").lower())
            size += len(parts[-1]) + 1
            end += 1
        hashes, starts, _ = hashed(b" ".join(parts), separators)
        bounds = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        yield begin, end - begin, hashes, np.searchsorted(starts, bounds)
        begin = end

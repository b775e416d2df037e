"""Word shingles of many texts as 64-bit numbers, and mixing of such numbers (numpy, one block of texts at a time)."""

from __future__ import annotations

import numpy as np
import xxhash

from aligngrid.llm.common import words_of

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the shingles in reading order, and the text of each.

    A text of fewer than `width` words has one shingle of all of them; one without words has none.
    """
    words, codes, counts = words_of(texts)
    of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    ends = np.cumsum(counts)
    n = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    text_of = np.repeat(np.arange(len(texts)), n)
    first = np.arange(len(text_of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends - counts, n)
    last = np.repeat(ends, n)
    out = np.zeros(len(first), np.uint64)
    flat = of_word[codes]
    for k in range(width):
        at = first + k
        inside = at < last
        if inside.all():
            out = mix(out ^ flat[at])
        else:
            out[inside] = mix(out[inside] ^ flat[at[inside]])
    return out, text_of

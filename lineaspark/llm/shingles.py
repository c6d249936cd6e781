"""Hashes of words and of word shingles of whole texts, in numpy and in bounded memory.

A word's hash is a polynomial in its bytes, read off one running sum over a
slice of the text; a shingle's mixes its words' hashes.  Texts are worked in
slices of about ``CHUNK`` bytes that end between words, and hashes of words
are carried over, so a slice's end never hides a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(n: int) -> list[np.ndarray]:
    """The first ``n + 1`` powers of a base and of its inverse."""
    return [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x)])) for x in (_BASE, _INVERSE)]


_POWERS = powers(CHUNK)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def other(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of a hash."""
    return mix(h * (_BASE if k else _INVERSE))


def word_hashes(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of one slice; ``is_word`` says which bytes belong to words."""
    up, down = _POWERS if len(data) <= CHUNK else powers(len(data))  # more only if one word is longer than a slice
    word = np.concatenate([[False], is_word[data], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * up[: len(data)])])
    return mix((total[end] - total[start]) * down[start]), start


def slices(data: np.ndarray, is_word: np.ndarray) -> Iterator[np.ndarray]:
    """The data in runs of at most ``CHUNK`` bytes that end between words; a longer word is in a run by itself."""
    at = 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        if end < len(data):
            gap = np.flatnonzero(~is_word[data[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:
                after = np.flatnonzero(~is_word[data[end:]])
                end = end + int(after[0]) if len(after) else len(data)
        yield data[at:end]
        at = end


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = hashes[:n].copy()
    for k in range(1, width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mix(h)

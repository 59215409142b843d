"""Hashes of words, word shingles and character n-grams, for a list of texts at a time."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (multiply and shift rounds)."""
    x = np.asarray(x, _U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def randoms(n: int, seed: int = 1) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), 95]] = True
_WORD[128:] = True
_MULTIPLIERS = randoms(4096, 7)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the lower-cased texts, and where each text's words begin (one more entry at the end).

    A word is a longest run of a-z, 0-9, underscores and non-ASCII characters.
    """
    coded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum(np.fromiter((len(c) + 1 for c in coded), np.int64, len(coded))) if coded else np.zeros(0, np.int64)
    raw = np.frombuffer(b"\n".join([*coded, b""]), np.uint8)
    inside = _WORD[raw]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.searchsorted(first, ends)])
    if not len(first):
        return np.zeros(0, _U), offsets
    length = last - first
    begin = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(begin, length)
    multipliers = _MULTIPLIERS if length.max() <= len(_MULTIPLIERS) else randoms(int(length.max()), 7)
    sums = np.add.reduceat((raw[inside].astype(_U) + _U(1)) * multipliers[place], begin)
    return mix(sums ^ length.astype(_U)), offsets


def shingles(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one text: hash, index of the text, index of the first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(n, _U)
    for i, c in enumerate(randoms(k, 11)):
        total += words[i : i + n] * c
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    return mix(total[at]), text[at], at

"""Hashes of words, word sequences and byte strings, for many texts at a time."""

from __future__ import annotations

import numpy as np

WORDS = 5
_RANDOM = np.random.default_rng(977)
_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True

_POWERS = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1, modulo 2 ** 64."""
    if len(_POWERS[base]) < n:
        steps = np.full(n + n // 2, base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums whose differences hash the bytes between two places, up to a power of the base (see ``between``)."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=sums[1:])
    return sums


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings from each start to its end."""
    return mixed((sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start])


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid one after another: start, end, text number and hash of each. White space is space and 9 to 13."""
    solid = ~_BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True  # no word crosses from text to text
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    last = np.zeros(len(data) + 1, bool)
    last[offsets[1:]] = True
    ends = np.flatnonzero(solid & (~after | last[1:])) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    sums = prefix_hashes(_LOWER[data] if lower else data)
    return starts, ends, owner, between(sums, starts, ends)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set of hashed word sequences of each text, sorted, one text after another, and the offset of each.

    Sequences have five words of the lower-cased text; a text with fewer words has them all as its only one, a text
    without words has none. Hashes have 64 bits.
    """
    n = len(offsets) - 1
    _, _, owner, hashes = words(data, offsets)
    counts = np.bincount(owner, minlength=n)
    at = np.concatenate([[0], np.cumsum(counts)])
    m = max(0, len(hashes) - WORDS + 1)
    rolled = np.zeros(m, np.uint64)
    for j in range(WORDS):
        rolled += hashes[j : j + m] * _PLACE[j]
    rolled = mixed(rolled)
    sets = []
    for i, (start, end) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if end - start >= WORDS:
            sets.append(np.unique(rolled[start : end - WORDS + 1]))
        elif end > start:
            short = (hashes[start:end] * _PLACE[: end - start]).sum(dtype=np.uint64) + np.uint64(end - start)
            sets.append(mixed(np.array([short])))
        else:
            sets.append(np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)

"""Sets of word shingles as 64-bit numbers, computed on the bytes of a text in numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5
SEGMENT = 1 << 18  # bytes whose words are numbered at a time

_BASE = 0x9E3779B97F4A7C15
_STEP = 0xC2B2AE3D27D4EB4F
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base of the rolling sums, and their inverses."""
    if len(_powers) < n:
        n = max(n, SEGMENT)
        for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers, _inverse


def _word_numbers(part: np.ndarray) -> np.ndarray:
    """One number per word of ``part``, which cuts no word."""
    powers, inverse = power_tables(len(part) + 1)
    space = np.ones(len(part) + 2, bool)
    space[1:-1] = _SPACE[part]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((_LOWER[part].astype(np.uint64) + np.uint64(1)) * powers[: len(part)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_numbers(data: bytes) -> np.ndarray:
    flat = np.frombuffer(data, np.uint8)
    found, begin = [], 0
    while begin < len(flat):
        end = min(begin + SEGMENT, len(flat))
        while end < len(flat) and not _SPACE[flat[end]]:
            gap = np.flatnonzero(_SPACE[flat[end : end + SEGMENT]])
            end = end + int(gap[0]) if len(gap) else min(end + SEGMENT, len(flat))
        found.append(_word_numbers(flat[begin:end]))
        begin = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text, sorted; a text of fewer words is one shingle."""
    numbers = word_numbers(text.encode("utf-8", "surrogatepass")) if text else np.zeros(0, np.uint64)
    if not len(numbers):
        return numbers
    wide = min(words, len(numbers))
    sums = np.full(len(numbers) - wide + 1, wide, np.uint64)
    for k in range(wide):
        sums = sums * np.uint64(_STEP) + numbers[k : len(numbers) - wide + 1 + k]
    return np.unique(mix(sums))

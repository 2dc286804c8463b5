"""Suffixes of texts: which ones to sort, front-coded sorted runs, and their LCP-aware merge."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from millrace.llm.shingles import mix, power_tables

GRAM = 48  # bytes that mark a suffix
SEGMENT = 1 << 18  # windows looked at in one go


def _sums(part: np.ndarray) -> np.ndarray:
    """Prefix sums from which a number for any run of bytes of ``part`` follows."""
    powers, _ = power_tables(len(part) + 1)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers[: len(part)], out=sums[1:])
    return sums


def _numbers(sums: np.ndarray, begin: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """A number for the bytes of each run from ``begin`` to ``end``."""
    _, inverse = power_tables(len(sums))
    return mix((sums[end] - sums[begin]) * inverse[: len(sums)][begin])


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def marked_suffixes(data: bytes, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``mark, place, first, last, context``: suffixes that stand for all windows of ``length`` bytes.

    Each window is represented by the suffix at its gram with the smallest number.  Equal
    windows choose alike, so a window can only be repeated if the mark of its suffix is;
    neighbouring windows mostly share a suffix.  ``first`` to ``last`` are the starts of
    the windows that the suffix at ``place`` represents, and ``context`` is a number for all
    bytes of these windows and the place of the suffix in them.
    """
    flat = np.frombuffer(data, np.uint8)
    width = length - gram + 1
    found = []
    for begin in range(0, len(flat) - length + 1, SEGMENT):
        part = flat[begin : begin + SEGMENT + length - 1]
        sums = _sums(part)
        numbers = _numbers(sums, slice(0, len(part) - gram + 1), slice(gram, None))
        packed = (numbers & ~np.uint64((1 << 20) - 1)) | np.arange(len(numbers), dtype=np.uint64)
        place = (_smallest(packed, width) & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], len(place)] - 1
        at = place[first]
        inside = ((at - first) << 32 | (last - first)).astype(np.uint64)
        context = mix(_numbers(sums, first, last + length) + mix(inside)).view(np.int64)
        found.append((numbers[at].view(np.int64), at + begin, first + begin, last + begin, context))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two texts that share ``known`` bytes."""
    n = min(len(a), len(b)) - known
    if n <= 0:
        return known + max(n, 0)
    end = known + n
    differ = int.from_bytes(a[known:end], "big") ^ int.from_bytes(b[known:end], "big")
    return end - (differ.bit_length() + 7) // 8


@dataclass
class Run:
    """Sorted texts, each with the length of the prefix it shares with the one before."""

    texts: list[bytes]
    shared: list[int]


def front_code(texts: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Shared prefix lengths and remaining bytes of sorted texts."""
    shared, rest, before = [], [], b""
    for text in texts:
        n = common_prefix(before, text, 0)
        shared.append(n)
        rest.append(text[n:])
        before = text
    return shared, rest


def front_decode(shared: list[int], rest: list[bytes]) -> Run:
    texts, before = [], b""
    for n, tail in zip(shared, rest, strict=True):
        before = before[:n] + tail
        texts.append(before)
    return Run(texts, list(shared))


def merge(runs: list[Run]) -> list[tuple[int, int, int]]:
    """Merge sorted runs; gives ``run, index, prefix shared with the text before`` in order.

    A loser tree over the heads of the runs.  Each head knows the prefix it shares with
    the last text given out.  Of two heads the one that shares more is smaller, and no
    byte is read; only if both share the same are they compared, from that byte on.  The
    loser remembers the prefix it shares with the winner, which is what it needs when
    its turn comes.
    """
    runs = [r for r in runs]
    width = 1
    while width < len(runs):
        width *= 2
    heads: list[bytes | None] = [r.texts[0] if r.texts else None for r in runs] + [None] * (width - len(runs))
    place = [0] * width
    shared = [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; sets what the loser shares with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        n = common_prefix(x, y, shared[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    losers = [0] * width
    winners = [0] * width + list(range(width))
    for node in range(width - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    winner = winners[1]
    out = []
    while heads[winner] is not None:
        run, i = runs[winner], place[winner]
        out.append((winner, i, shared[winner]))
        i += 1
        place[winner] = i
        if i < len(run.texts):
            heads[winner], shared[winner] = run.texts[i], run.shared[i]
        else:
            heads[winner] = None
        node = (winner + width) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
    return out


def repeated_windows(
    shared: np.ndarray, left: np.ndarray, nearest: np.ndarray, farthest: np.ndarray, length: int
) -> np.ndarray:
    """Which windows of merged suffixes occur twice.

    Row ``j`` is a suffix in sorted order that shares ``shared[j]`` bytes with the one before,
    and ``left`` holds the bytes before it, nearest first.  Window ``d`` starts ``d`` bytes
    before the suffix, for ``nearest <= d <= farthest``.  It is equal to another one if both
    suffixes share the window's other bytes (then all between them do) and the ``d`` bytes
    before them are equal too.
    """
    rows, width = len(shared), left.shape[1] + 1
    repeated = np.zeros((rows, width), bool)
    powers, _ = power_tables(width + 1)
    before = np.zeros(rows, np.uint64)
    for d in range(width):
        if d:
            before = before + (left[:, d - 1].astype(np.uint64) + np.uint64(1)) * powers[d]
        group = np.cumsum(shared < length - d)
        own = np.flatnonzero((nearest <= d) & (d <= farthest))
        key = mix(mix(before[own]) + group[own].astype(np.uint64))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(own), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        repeated[own, d] = twice
    return repeated

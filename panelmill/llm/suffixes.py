"""Suffix arrays by induced sorting and permuted common prefixes, written over numpy arrays."""

from __future__ import annotations

import numpy as np

RECURSIVE_NAMES = 1024


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S); equal neighbours follow the next change."""
    n = len(t)
    change = np.flatnonzero(t[:-1] != t[1:])
    upto = np.searchsorted(change, np.arange(n - 1))
    smaller = np.ones(n, bool)
    inside = upto < len(change)
    at = change[upto[inside]]
    smaller[:-1][inside] = t[at] < t[at + 1]
    return smaller


def _dealt(waves: list[list[np.ndarray]], positions: np.ndarray, chars: np.ndarray) -> None:
    """Appends positions to the waves of their characters, keeping their order."""
    if not len(positions):
        return
    order = np.argsort(chars, kind="stable")
    positions, chars = positions[order], chars[order]
    cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    for part, c in zip(np.split(positions, cuts), chars[np.concatenate(([0], cuts))].tolist()):
        waves[c].append(part)


def _induced(t: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, from the order of the leftmost smaller ones: one pass up for L, one pass down for S."""
    by_char: list[list[np.ndarray]] = [[] for _ in range(size)]
    _dealt(by_char, lms, t[lms])
    large: list[list[np.ndarray]] = [[] for _ in range(size)]

    def push(found: np.ndarray, c: int, waves: list[list[np.ndarray]], kind: bool) -> np.ndarray:
        """Deals the predecessors of one kind; those in the same bucket are the next wave."""
        before = found[found > 0] - 1
        before = before[small[before] == kind]
        chars = t[before]
        own = chars == c
        _dealt(waves, before[~own], chars[~own])
        return before[own]

    def waves(bucket: list[np.ndarray], c: int, target: list[list[np.ndarray]], kind: bool) -> list[np.ndarray]:
        """Pushes a bucket; what it adds to itself comes after all that was there."""
        done, now = [], np.concatenate(bucket) if bucket else np.zeros(0, np.int64)
        while len(now):
            done.append(now)
            now = push(now, c, target, kind)
        return done

    for c in range(size):
        large[c] = waves(large[c], c, large, False)
        for part in by_char[c]:
            push(part, c, large, False)
    down: list[list[np.ndarray]] = [[] for _ in range(size)]
    for c in range(size - 1, -1, -1):
        down[c] = waves(down[c], c, down, True)
        for part in reversed(large[c]):
            push(part[::-1], c, down, True)
    down[int(t[-1])].append(np.array([len(t) - 1]))  # the end of the text is the smallest suffix and follows nothing
    out = []
    for c in range(size):
        out += large[c]
        out += [part[::-1] for part in reversed(down[c])]
    return np.concatenate(out)


def _names(t: np.ndarray, order: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Numbers of the sorted leftmost-smaller substrings, equal ones alike; ``stop[p]`` is the end (inclusive) of the one at p."""
    a, b = order[:-1], order[1:]
    differs = (stop[a] - a) != (stop[b] - b)
    open_pairs = np.flatnonzero(~differs)
    k = 0
    while len(open_pairs):
        x, y = a[open_pairs] + k, b[open_pairs] + k
        unlike = t[x] != t[y]
        differs[open_pairs[unlike]] = True
        open_pairs = open_pairs[~unlike & (x < stop[a[open_pairs]])]
        k += 1
    return np.concatenate(([0], np.cumsum(differs)))


def _doubled(names: np.ndarray, depth: int | None) -> np.ndarray:
    """Order of the suffixes of a string of numbers by rank doubling, over ``depth`` numbers or all of them."""
    rank, k, n = names.astype(np.int64), 1, len(names)
    while True:
        tail = np.zeros(n, np.int64)
        tail[:-k] = rank[k:] + 1
        key = rank * (n + 2) + tail
        order = np.argsort(key)
        ranked = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        rank, k = fresh, 2 * k
        if rank[order[-1]] == n - 1 or k >= n or (depth and k >= depth):
            return order


def suffix_array(t: np.ndarray, size: int, depth: int | None = None) -> np.ndarray:
    """Suffixes of ``t`` in order; ``t`` holds numbers below ``size`` and ends in its only 0.

    With ``depth`` suffixes that agree on so many characters may come in any order. Names of leftmost-smaller substrings are sorted
    by the same procedure while they are few; a large alphabet has too many buckets for array passes, and its
    string, a third as long, is ordered by doubling ranks.
    """
    if len(t) < 3:
        return np.argsort(t, kind="stable")
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) < 2:
        return _induced(t, small, lms, size)
    rough = _induced(t, small, lms, size)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    order = rough[is_lms[rough]]
    stop = np.zeros(len(t), np.int64)
    stop[lms[:-1]] = lms[1:]
    stop[lms[-1]] = lms[-1]
    numbers = _names(t, order, stop)
    if numbers[-1] + 1 == len(lms):
        return _induced(t, small, order, size)
    named = np.empty(len(t), np.int64)
    named[order] = numbers
    reduced = named[lms]
    few = numbers[-1] + 1 <= RECURSIVE_NAMES
    inner_depth = depth and depth // 2 + 2  # a name spans two characters at least
    inner = suffix_array(reduced, int(numbers[-1]) + 1, inner_depth) if few else _doubled(reduced, inner_depth)
    return _induced(t, small, lms[inner], size)


def common_prefixes(t: np.ndarray, order: np.ndarray, length: int, at: np.ndarray | None = None) -> np.ndarray:
    """Permuted: for each position (of ``at``, if given), the characters it shares with the suffix before it in order, up to ``length``.

    ``t`` holds numbers below 2^16; four are compared at a time. Its only 0 at the end stops every comparison.
    """
    n = len(t)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    wide = np.concatenate((t, np.zeros(length + 8, t.dtype))).astype(np.uint64)
    words = wide[:-3] | wide[1:-2] << np.uint64(16) | wide[2:-1] << np.uint64(32) | wide[3:] << np.uint64(48)
    shared = np.zeros(n, np.int64)
    live = np.arange(n) if at is None else at
    live, ended = live[before[live] >= 0], []
    for k in range(0, length - 3, 4):
        same = words[live + k] == words[before[live] + k]
        ended.append(live[~same])
        live = live[same]
        shared[live] = k + 4
    rest = np.concatenate([*ended, live])
    for _ in range(3):
        s = shared[rest]
        rest = rest[(s < length) & (wide[rest + s] == wide[before[rest] + s])]
        shared[rest] += 1
    return shared

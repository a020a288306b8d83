"""Suffix sorting by difference cover, vectorised."""

from __future__ import annotations

import numpy as np


def _names(*parts: np.ndarray) -> tuple[np.ndarray, int]:
    """Order-preserving names 1..m of the tuples (parts[0][i], parts[1][i], ...)."""
    key = parts[0].astype(np.int64)
    for part in parts[1:]:
        width = int(part.max(initial=0)) + 1
        if int(key.max(initial=0)) >= (1 << 62) // width:  # would overflow: name what there is first
            key, _ = _names(key)
        key = key * width + part
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(len(key), dtype=np.int64)
    new[1:] = ranked[1:] != ranked[:-1]
    names = np.empty(len(key), dtype=np.int64)
    names[order] = np.cumsum(new)
    return names, int(new.sum())


def suffix_array(s: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Starts of the suffixes of `s` (integers, 1 or more) in order.

    Positions 1 and 2 modulo 3 are the sample: their triples are sorted and named,
    the names' string is sorted by recursion, then positions 0 modulo 3 are sorted by
    (symbol, rank of the next) and merged in.  With `depth`, suffixes that agree in
    their first `depth` symbols may come in any order: once the triples of a level
    span that many symbols, their names need no recursion.
    """
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    padded = np.concatenate([s.astype(np.int64), np.zeros(3, dtype=np.int64)])
    ones = np.arange(1, n + (n % 3 == 1), 3)  # with a dummy at n where n is 1 modulo 3
    sample = np.concatenate([ones, np.arange(2, n, 3)])
    names, distinct = _names(padded[sample], padded[sample + 1], padded[sample + 2])
    if distinct == len(sample) or (depth is not None and depth <= 3):
        order = np.argsort(names, kind="stable")
    else:
        order = suffix_array(names, None if depth is None else -(-depth // 3))
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    ranked = sample[order]
    ranked = ranked[ranked < n]
    width = len(sample) + 2
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(padded[zeros] * width + rank[zeros + 1])]

    # Merge: where each suffix of one kind falls among those of the other.
    with_one = padded[zeros] * width + rank[zeros + 1]
    is_one = ranked % 3 == 1
    symbols = int(padded.max()) + 1
    if symbols * symbols * width < 1 << 62:
        pairs = padded[:-1] * symbols + padded[1:]
        two_zeros, two_sample = pairs[zeros] * width + rank[zeros + 2], pairs[ranked] * width + rank[ranked + 2]
    else:
        both = np.concatenate([zeros, ranked])
        two, _ = _names(padded[both], padded[both + 1], rank[both + 2])
        two_zeros, two_sample = two[: len(zeros)], two[len(zeros) :]
    before = np.empty(len(ranked), dtype=np.int64)  # suffixes 0 modulo 3 that come before each sampled one
    before[is_one] = np.searchsorted(with_one, padded[ranked[is_one]] * width + rank[ranked[is_one] + 1], side="left")
    before[~is_one] = np.searchsorted(two_zeros, two_sample[~is_one], side="left")
    before = np.maximum.accumulate(before)  # ties beyond `depth` must not cross
    out = np.empty(n, dtype=np.int64)
    at = before + np.arange(len(ranked))
    out[at] = ranked
    rest = np.ones(n, dtype=bool)
    rest[at] = False
    out[rest] = zeros
    return out


def equal_windows(text: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Class numbers of the windows text[p : p + size] for p in `starts`: equal windows, equal numbers.

    Sorts all suffixes of `text` (integers, 1 or more), then compares adjacent prefixes.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    wanted = np.full(len(text), -1, dtype=np.int64)
    wanted[starts] = np.arange(len(starts))
    order = suffix_array(text, size)
    order = order[wanted[order] >= 0]
    windows = np.lib.stride_tricks.sliding_window_view(text, size)
    differs = np.ones(len(order), dtype=np.int64)
    for i in range(1, len(order), 50_000):
        j = min(len(order), i + 50_000)
        a, b = order[i - 1 : j - 1], order[i:j]
        ends = (text[a] != text[b]) | (text[a + size - 1] != text[b + size - 1])
        close = np.flatnonzero(~ends)
        differs[i:j] = 1
        differs[i + close] = (windows[a[close]] != windows[b[close]]).any(axis=1)
    classes = np.empty(len(starts), dtype=np.int64)
    classes[wanted[order]] = np.cumsum(differs)
    return classes

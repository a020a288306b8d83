"""Content-defined anchors of fixed-length windows over symbol sequences.

Every window of `size` symbols picks the leftmost of its smallest k-gram
hashes.  The pick depends on the window's content alone, so equal windows,
wherever they lie, pick the same k-gram at the same offset.  Window starts that
pick one k-gram are contiguous, so a document becomes a list of anchors that
own disjoint ranges of its windows, about 2 / (size - k + 2) anchors a symbol.
Two documents can only share a window where they share an anchor: this is how
the repeat removers deal windows out to tasks without a row for each window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_POS_BITS = np.uint64(24)
_POS_MASK = np.uint64((1 << 24) - 1)
MAX_SYMBOLS = 1 << 23  # of one call; callers cut longer documents with overlap

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        m = max(1 << 16, 1 << (n - 1).bit_length())
        steps = np.full(m, np.uint64(base), dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


class RollingHash:
    """Hashes of any slice of one symbol sequence in constant time each."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes * _power_table(_BASE, n), out=self.sums[1:])
        self.back = _power_table(_BASE_INVERSE, n + 1)

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def kgrams(self, k: int) -> np.ndarray:
        s = self.sums
        return mix((s[k:] - s[:-k]) * self.back[: len(s) - k])


@dataclass
class Anchors:
    """One entry for each anchor; positions are relative to the document."""

    doc: np.ndarray  # index of the document in the call
    at: np.ndarray  # where the k-gram starts
    first: np.ndarray  # first window start that picks it
    last: np.ndarray  # last window start that picks it
    key: np.ndarray  # hash of the k-gram
    context: np.ndarray  # hash of all symbols of all windows that could hold it


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = w - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(codes: np.ndarray, lengths: np.ndarray, size: int, k: int) -> Anchors:
    """Anchors of documents whose symbol codes lie one after another in `codes`.

    `lengths` gives the documents' lengths; windows never cross documents.
    """
    none = np.zeros(0, dtype=np.int64)
    empty = Anchors(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    if len(codes) < size:
        return empty
    ends = np.cumsum(lengths)
    starts = ends - lengths
    hashes = RollingHash(codes)
    grams = hashes.kgrams(k)
    ranked = (grams & ~_POS_MASK) | np.arange(len(grams), dtype=np.uint64)
    picked = (sliding_min(ranked, size - k + 1) & _POS_MASK).astype(np.int64)
    if len(lengths) > 1:
        doc_of = np.repeat(np.arange(len(lengths)), lengths)[: len(picked)]
        fits = np.flatnonzero(np.arange(len(picked)) + size <= ends[doc_of])
        if not len(fits):
            return empty
        at, doc = picked[fits], doc_of[fits]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
        at, doc, first = at[new], doc[new], fits[new]
        last = fits[np.concatenate([new[1:] - 1, [len(fits) - 1]])]
    else:
        new = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
        at, first = picked[new], new
        last = np.concatenate([new[1:] - 1, [len(picked) - 1]])
        doc = np.zeros(len(new), dtype=np.int64)
    left = np.maximum(starts[doc], at + k - size)
    right = np.minimum(ends[doc], at + size)
    clip = ((at - left).astype(np.uint64) << np.uint64(32)) | (right - at).astype(np.uint64)
    context = mix(hashes.slices(left, right) ^ (clip * np.uint64(0x9E3779B97F4A7C15)))
    base = starts[doc]
    return Anchors(doc, at - base, first - base, last - base, grams[at], context)

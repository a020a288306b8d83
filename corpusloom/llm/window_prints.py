"""SimHash fingerprints of all windows of a sequence of hashes, with bit-sliced counters.

A count of set bits over a window is kept as slices: word i of slice j holds bit j of the
counts of all 64 hash bits of window i.  Adding two windows is a ripple of full adders on
whole arrays, windows grow by doubling, and "over half of the hashes" is the carry of one
more addition.  A window costs a few dozen word operations whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

Slices = list[np.ndarray]


def add(a: Slices, b: Slices) -> Slices:
    """Sums of two arrays of bit-sliced counters, lowest slice first."""
    if len(a) < len(b):
        a, b = b, a
    out, carry = [], None
    for i, x in enumerate(a):
        if i < len(b):
            half = x ^ b[i]
            out.append(half if carry is None else half ^ carry)
            carry = x & b[i] if carry is None else (x & b[i]) | (half & carry)
        elif carry is None:
            out.append(x)
        else:
            out.append(x ^ carry)
            carry = x & carry
    return [*out, carry] if carry is not None else out


def over_half(sums: Slices, n: int) -> np.ndarray:
    """Words whose bits say where more than half of n hashes have the bit set: the carry of count + (2^slices - n // 2 - 1)."""
    constant = (1 << len(sums)) - n // 2 - 1
    carry = np.zeros_like(sums[0])
    for i, x in enumerate(sums):
        carry = x | carry if constant >> i & 1 else x & carry
    return carry


def window_prints(hashes: np.ndarray, stride: int, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(blocks, fingerprints) for each of the ascending `sizes`: windows of so many blocks of `stride` hashes, one at each block."""
    n = len(hashes) // stride
    shift = lambda s, by: [x[by:] for x in s]
    blocks: Slices = [hashes[: n * stride : stride]]
    for r in range(1, stride):
        blocks = add(blocks, [hashes[r : n * stride : stride]])
    doubled = [blocks]
    at, sums = 0, None
    for size in sizes:
        if size > n:
            return
        for p in range((size - at).bit_length()):
            if len(doubled) <= p:
                last, by = doubled[-1], 1 << (p - 1)
                doubled.append(add([x[:-by] for x in last], shift(last, by)))
            if (size - at) >> p & 1:
                low = (size - at) & ((1 << p) - 1)  # blocks of lower powers come first
                part = shift(doubled[p], at + low)
                sums = part if sums is None else add([x[: len(part[0])] for x in sums], [x[: len(sums[0])] for x in part])
        at, sums = size, [x[: n - size + 1] for x in sums]
        yield size, over_half(sums, size * stride)

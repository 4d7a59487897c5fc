"""Vectors of integers in flat blocks along a Hilbert curve, and exact nearest entries by the boxes of blocks.

A block is some vectors that follow each other on the curve, with the least and greatest value of each component (its
box) and the components' sums. The distances of an entry to the box bound those to every member, so most entries drop
out for a block as a whole; what stays is compared with each member in exact integers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of a comparison that are held at once (members times entries times components).
CELLS = 1 << 21


def sound(vector: Column) -> Column:
    """Not null, and every component a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def floors(vector: Column, scale: int, most: int) -> Column:
    """floor(scale * x) of every component, x as a double. Beyond +-most, distances might not fit a long: an error."""

    def one(x: Column) -> Column:
        v = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double")) * scale < most, v).otherwise(F.raise_error(F.lit(f"a component beyond {most} / {scale} has no exact distance in 64 bits")).cast("long")).cast("int")

    return F.transform(vector, one)


def largest(width: int) -> int:
    """A bound of components, so that squared distances over ``width`` of them fit 62 bits."""
    return int((2**62 / max(width, 1)) ** 0.5 / 2)


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (n, d) with coordinates below 2^bits, d * bits at most 62.

    From the highest bit down, each axis whose bit is set turns the lower bits of the first axis over, each other one
    swaps them with the first axis's: that turns a cell's curve so that it starts where that of the last cell ended. The
    bits are then a Gray code across the axes, read off in turns.
    """
    a = np.asarray(x, np.int64).T.copy()
    d = len(a)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(d):
            on = (a[i] >> b) & 1 == 1
            swap = np.where(on, 0, (a[0] ^ a[i]) & low)
            a[0] ^= np.where(on, low, swap)
            a[i] ^= swap
    for i in range(1, d):
        a[i] ^= a[i - 1]
    turn = np.zeros(a.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((a[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    a ^= turn
    key = np.zeros(a.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((a[i] >> b) & 1)
    return key


def grid(x: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    """Coordinates as cells of 2^bits between low and high; what lies outside goes to the cells at the ends."""
    span = np.where(high > low, high - low, 1)
    return np.clip((x - low) / span * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)


def flat(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted vectors (n, w) in blocks: (members (b, size, w), counts, lows, highs, sums); the last is filled up with its
    last member, which the sums leave out."""
    b = -(-len(x) // size)
    members = np.concatenate([x, np.repeat(x[-1:], b * size - len(x), 0)]).reshape(b, size, x.shape[1])
    counts = np.full(b, size)
    counts[-1] = len(x) - (b - 1) * size
    sums = np.add.reduceat(x, np.arange(0, len(x), size), axis=0, dtype=np.int64)
    return members, counts, members.min(1), members.max(1), sums


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(blocks, entries): which may be the nearest of some member, ties to the lower index.

    Dropped are entries farther from the box than the best one is from its farthest corner, and entries that this best
    one is nearer than at every point of the box.
    """
    lo, hi, e = low[:, None].astype(np.int64), high[:, None].astype(np.int64), entries[None].astype(np.int64)
    near = (np.maximum(np.maximum(lo - e, e - hi), 0) ** 2).sum(2)
    far = (np.maximum(np.abs(e - lo), np.abs(e - hi)) ** 2).sum(2)
    best = far.argmin(1)
    may = near <= far.min(1)[:, None]
    # |x - best|^2 - |x - e|^2 is linear in x, so its greatest value over the box is that of one corner
    d = e - entries[best][:, None].astype(np.int64)
    most = (2 * np.where(d > 0, hi * d, lo * d)).sum(2) + (entries[best].astype(np.int64) ** 2).sum(1)[:, None] - (e**2).sum(2)
    later = np.arange(len(entries))[None] > best[:, None]
    return may & ~((most < 0) | ((most == 0) & later))


def nearest(members: np.ndarray, may: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance), each (blocks, size): the nearest of each block's entries, ties to the lower index."""
    b, size, w = members.shape
    index, distance = np.zeros((b, size), np.int64), np.zeros((b, size), np.int64)
    many = may.sum(1)
    for c in np.unique(many).tolist():
        at = np.flatnonzero(many == c)
        for lo in range(0, len(at), max(1, CELLS // (size * c * w))):
            i = at[lo : lo + max(1, CELLS // (size * c * w))]
            own = np.nonzero(may[i])[1].reshape(len(i), c)
            d = ((members[i].astype(np.int64)[:, :, None] - entries[own].astype(np.int64)[:, None]) ** 2).sum(3)
            k = d.argmin(2)
            index[i] = np.take_along_axis(own[:, None].repeat(size, 1), k[:, :, None], 2)[:, :, 0]
            distance[i] = np.take_along_axis(d, k[:, :, None], 2)[:, :, 0]
    return index, distance


def gathered(members: np.ndarray, counts: np.ndarray, sums: np.ndarray, low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the vectors nearest to each entry. A block with one entry left gives its stored sums as they are."""
    total, count = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    may = shortlists(low, high, entries)
    one = may.sum(1) == 1
    k = may.argmax(1)
    np.add.at(total, k[one], sums[one])
    np.add.at(count, k[one], counts[one])
    if (~one).any():
        m = members[~one]
        index, _ = nearest(m, may[~one], entries)
        real = np.arange(m.shape[1])[None] < counts[~one][:, None]
        np.add.at(total, index[real], m[real].astype(np.int64))
        np.add.at(count, index[real], 1)
    return total, count


def moved(entries: np.ndarray, found: list) -> np.ndarray:
    """Entries after a round: floor(sum / count) by component of (entry, component, sum, count); unused ones as before."""
    out = entries.copy()
    for r in found:
        if r["n"]:
            out[r["entry"], r["dim"]] = int(r["s"]) // int(r["n"])
    return out


def narrowed(x: np.ndarray) -> np.ndarray:
    """The smallest type of integers that holds them all, for storage."""
    for kind in (np.int8, np.int16):
        if len(x) and np.abs(x).max() <= np.iinfo(kind).max:
            return x.astype(kind)
    return x.astype(np.int32)

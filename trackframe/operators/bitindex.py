"""Nearest bit strings of one block by multi-index hashing, in numpy.

The varying bits are cut into m bands. A string not met after all bands are probed up
to radius r - 1, and j of them to radius r, differs by more than r bits in those j bands
and by r or more in the others, so by m * r + j bits at least. A distance below that is
proven to be the least, ties included.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

# Blocks below this size are compared whole; strings asked at a time.
INDEXED, STEP = 512, 256
# A probe costs about as much as two distances of a whole comparison.
PROBE_COST = 2


def _varying(mine: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
    """(word, bit) places that are not the same everywhere."""
    places = []
    for w, (x, y) in enumerate(zip(mine, other, strict=True)):
        seen = int(np.bitwise_or.reduce(x ^ y[0]) | np.bitwise_or.reduce(y ^ y[0]))
        places += [(w, bit) for bit in range(64) if seen >> bit & 1]
    return places


def _keys(words: np.ndarray, band: list[tuple[int, int]]) -> np.ndarray:
    """The bits of a band as one number."""
    key = np.zeros(words.shape[1], np.int64)
    for at, (w, bit) in enumerate(band):
        key |= ((words[w] >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << at
    return key


def _masks(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits with ``radius`` bits set."""
    return np.array([sum(1 << i for i in some) for some in combinations(range(width), radius)])


def _distances(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    return sum(
        np.bitwise_count(x ^ y).astype(np.int64) for x, y in zip(mine, other, strict=True)
    )


class _Band:
    """Places of ``other`` by the value of one band."""

    def __init__(self, mine: np.ndarray, other: np.ndarray, band: list[tuple[int, int]]):
        keys = _keys(other, band)
        self.asked = _keys(mine, band)
        self.order = np.argsort(keys, kind="stable")
        self.start = np.concatenate([[0], np.bincount(keys, minlength=1 << len(band)).cumsum()])
        self.width = len(band)

    def probe(self, asks: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of places for each ask and mask."""
        keys = self.asked[asks][:, None] ^ masks[None, :]
        first = self.start[keys]
        return first, self.start[keys + 1] - first

    def places(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The places of all probes, in the order of the probes."""
        first, count = first.ravel(), count.ravel()
        shift = np.repeat(first - (count.cumsum() - count), count)
        return self.order[shift + np.arange(len(shift))]


def nearest(mine: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Place and distance of the nearest of ``other`` for each of ``mine``.

    Both are uint64 arrays (words, strings); ties go to the lowest place. Strings
    without a near one, or whose probes would find much of the block, are compared
    with the whole block, so no case costs much more than that. The third value is
    the number of distances computed.
    """
    size, n = mine.shape[1], other.shape[1]
    least = np.full(size, np.iinfo(np.int64).max)  # distance * n + place
    left, crowded, looked = np.arange(size), [], 0
    bits = _varying(mine, other) if n >= INDEXED else []
    if bits:
        m = max(1, round(len(bits) / np.log2(n)))
        cuts = np.array_split(np.arange(len(bits)), m)
        bands = [_Band(mine, other, [bits[i] for i in some]) for some in cuts]
        found = np.zeros(size, np.int64)
        radius, narrowest = 0, min(band.width for band in bands)
        while len(left) and radius <= narrowest:
            masks = [_masks(band.width, radius) for band in bands]
            if PROBE_COST * sum(len(some) for some in masks) > n:
                break
            for at in range(0, len(left), STEP):
                asks = left[at : at + STEP]
                for done, (band, some) in enumerate(zip(bands, masks, strict=True), 1):
                    first, count = band.probe(asks, some)
                    hits = count.sum(axis=1)
                    found[asks] += hits
                    few = (found[asks] <= n // 4) & (hits > 0)
                    if few.any():
                        place = band.places(first[few], count[few])
                        who = np.repeat(asks[few], hits[few])
                        rank = _distances(mine[:, who], other[:, place]) * n + place
                        starts = np.concatenate([[0], hits[few].cumsum()[:-1]])
                        best = np.minimum.reduceat(rank, starts)
                        least[asks[few]] = np.minimum(least[asks[few]], best)
                        looked += len(place)
                    open_ = least[asks] // n >= m * radius + done
                    asks = asks[open_ & (found[asks] <= n // 4)]
                    if not len(asks):
                        break
            radius += 1
            left = left[least[left] // n >= m * radius]
            crowded.append(left[found[left] > n // 4])
            left = left[found[left] <= n // 4]
    left = np.concatenate([left, *crowded])
    for at in range(0, len(left), STEP):
        asks = left[at : at + STEP]
        far = _distances(mine[:, asks, None], other[:, None, :])
        place = far.argmin(axis=1)
        least[asks] = far[np.arange(len(asks)), place] * n + place
        looked += far.size
    return least % n, (least // n).astype(np.int32), looked

"""Best-fit-decreasing bin packing with a segment tree over remaining capacities."""

from __future__ import annotations

import numpy as np


class CapacityTree:
    """Open bins by remaining capacity; finds the least capacity that still takes an item in O(log capacity)."""

    def __init__(self, capacity: int):
        self.width = 1 << int(capacity).bit_length()
        self.count = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        if len(self.bins[room]) == 1:
            self._mark(room, 1)

    def _mark(self, room: int, by: int) -> None:
        at, count = room + self.width, self.count
        while at:
            count[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) with the least room >= need, or None."""
        at, count = need + self.width, self.count
        if at >= 2 * self.width:
            return None
        if not count[at]:
            while True:
                if at & 1 == 0 and count[at + 1]:
                    at += 1
                    break
                at >>= 1
                if at <= 1:
                    return None
            while at < self.width:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.width
        bin_ = self.bins[room].pop()
        if not self.bins[room]:
            self._mark(room, -1)
        return room, bin_


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pack items of 1..capacity. Returns each item's bin and offset, and each bin's fill. Ties go by input order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, fills = CapacityTree(capacity), []
    sizes = lengths.tolist()
    for item in order.tolist():
        size = sizes[item]
        if found := tree.take(size):
            room, bin_ = found
            bins[item], offsets[item] = bin_, capacity - room
            fills[bin_] += size
        else:
            bin_, room = len(fills), capacity
            bins[item] = bin_
            fills.append(size)
        if room > size:
            tree.add(room - size, bin_)
    return bins, offsets, np.array(fills, np.int64)

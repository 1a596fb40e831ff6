"""Bin packing over size histograms: plans whose length follows the number of distinct sizes, not of items.

Items of one size are interchangeable, so a packing is fully told by runs: items ``lo`` to ``hi`` of a size go to
consecutive bins from ``first_bin`` on, ``per_bin`` to each. Histograms hold one row per size and a size is an
integer up to the capacity, so what reaches the driver is bounded by the capacity, whatever the number of items.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Run:
    """Items ``lo``..``hi - 1`` of ``size``, ``per_bin`` to each bin from ``first_bin`` on."""

    size: int
    lo: int
    hi: int
    first_bin: int
    per_bin: int


class Bins:
    """Open bins as runs of consecutive bins with the same room left, in the order in which they were opened."""

    def __init__(self, capacity: int, opened: int = 0) -> None:
        self.capacity, self.opened = capacity, opened
        self.start: list[int] = []
        self.count: list[int] = []
        self.room = np.zeros(0, dtype=np.int64)

    def _replace(self, at: int, parts: list[tuple[int, int, int]]) -> None:
        kept = [p for p in parts if p[1]]
        self.start[at : at + 1] = [p[0] for p in kept]
        self.count[at : at + 1] = [p[1] for p in kept]
        self.room = np.concatenate([self.room[:at], np.array([p[2] for p in kept], dtype=np.int64), self.room[at + 1 :]])

    def put(self, at: int, size: int, lo: int, n: int, per_bin: int) -> list[Run]:
        """Up to ``n`` items into the run of bins ``at``, ``per_bin`` to each; the last bin may get fewer."""
        start, count, room = self.start[at], self.count[at], int(self.room[at])
        full, rest = divmod(min(n, per_bin * count), per_bin)
        done = full * per_bin + rest
        used = full + bool(rest)
        self._replace(at, [(start, full, room - per_bin * size), (start + full, int(bool(rest)), room - rest * size), (start + used, count - used, room)])
        return [Run(size, lo, lo + done, start, per_bin)]

    def open(self, size: int, lo: int, n: int) -> list[Run]:
        """``n`` items of ``size`` into new bins, as many to each as fit."""
        per_bin = max(1, self.capacity // size)
        bins = -(-n // per_bin)
        self.start.append(self.opened)
        self.count.append(bins)
        self.room = np.append(self.room, self.capacity)
        self.opened += bins
        return self.put(len(self.start) - 1, size, lo, n, per_bin)


def first_fit_decreasing(sizes: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Each item, largest first, into the first bin with room for it. ``sizes``: size -> number of items.

    Sizes must lie in 1..capacity. Returns the runs and the number of bins.
    """
    bins, runs = Bins(capacity), []
    for size in sorted(sizes, reverse=True):
        lo, n = 0, sizes[size]
        at = 0
        while lo < n:
            fits = np.flatnonzero(bins.room[at:] >= size)
            if not len(fits):
                runs += bins.open(size, lo, n - lo)
                break
            at += int(fits[0])
            placed = bins.put(at, size, lo, n - lo, int(bins.room[at]) // size)
            lo = placed[-1].hi
            runs += placed
    return runs, bins.opened


def best_fit_decreasing(sizes: dict[int, int], capacity: int, offsets: dict[int, int] | None = None, opened: int = 0) -> tuple[list[Run], int]:
    """Each item, largest first, into the bin with the least room that still takes it.

    ``offsets``: number of items of a size that were placed before; ``opened``: bins that exist already and are
    closed. Returns the runs and the number of bins, closed ones included.
    """
    bins, runs, offsets = Bins(capacity, opened), [], offsets or {}
    for size in sorted(sizes, reverse=True):
        lo = offsets.get(size, 0)
        end = lo + sizes[size]
        while lo < end:
            fits = np.flatnonzero(bins.room >= size)
            if not len(fits):
                runs += bins.open(size, lo, end - lo)
                break
            at = int(fits[np.argmin(bins.room[fits])])
            # the fullest bin stays the best one until it can take no more
            placed = bins.put(at, size, lo, end - lo, int(bins.room[at]) // size)
            lo = placed[-1].hi
            runs += placed
    return runs, bins.opened

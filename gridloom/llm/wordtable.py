"""Numbers for each distinct word, made once a worker, and their sums over texts."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

#: Words a table holds before it is emptied.
CAPACITY = 200_000


class WordTable:
    """``fill`` makes a row of ``width`` numbers for each of a list of words; equal words are filled once."""

    def __init__(self, width: int, fill: Callable[[list[str]], np.ndarray], capacity: int = CAPACITY):
        self.fill, self.capacity, self.width = fill, capacity, width
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, width), np.float32)

    def ids(self, lists: list[list[str]]) -> np.ndarray:
        """The words' row numbers, all lists in a row."""
        new = set().union(*lists).difference(self.index) if lists else set()
        if self.index and len(self.index) + len(new) > self.capacity:
            self.index = {}
            new = set().union(*lists)
        if new:
            words, n = sorted(new), len(self.index)
            made = self.fill(words)
            if n + len(words) > len(self.rows):
                self.rows = np.concatenate([self.rows[:n], np.zeros((max(n, len(words)) + 1024, self.width), np.float32)])
            self.rows[n : n + len(words)] = made
            self.index.update(zip(words, range(n, n + len(words)), strict=True))
        return np.fromiter(map(self.index.__getitem__, chain.from_iterable(lists)), np.int64, sum(map(len, lists)))

    def sums(self, lists: list[list[str]]) -> np.ndarray:
        """For each list the sum of its words' rows."""
        ids = self.ids(lists)
        return summed(self.rows[ids], np.array([len(x) for x in lists], np.int64))


def summed(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; a run may be empty."""
    out = np.zeros((len(counts), rows.shape[1]), np.float64)
    has = counts > 0
    if has.any():
        starts = (np.cumsum(counts) - counts)[has]
        out[has] = np.add.reduceat(rows, starts, axis=0, dtype=np.float64)
    return out

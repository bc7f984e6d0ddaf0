"""The best few (score, id) of many keys, kept while a task's rows pass by."""

from __future__ import annotations

import numpy as np


def run_places(starts: np.ndarray) -> np.ndarray:
    """Place of each element in its run; ``starts`` marks where runs begin."""
    at = np.arange(len(starts))
    return at - np.maximum.accumulate(np.where(starts, at, 0)) if len(starts) else at


class Best:
    """The ``k`` best (score, id) of each of many keys: higher scores first, then smaller ids."""

    def __init__(self, keys: int, k: int) -> None:
        self.k, self.least = k, np.full(keys, -np.inf)
        self.key, self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids = np.append(self.key, key), np.append(self.score, score.astype(np.int64)), np.append(self.id, ids)
        order = np.lexsort((ids, -score, key))
        rank = run_places(np.append(True, key[order][1:] != key[order][:-1]))
        full = order[rank == self.k - 1]
        self.least[key[full]] = score[full]
        order = order[rank < self.k]
        self.key, self.score, self.id = key[order], score[order], ids[order]

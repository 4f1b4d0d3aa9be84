"""Maximum-weight assignment (shortest augmenting paths with potentials), in NumPy."""

from __future__ import annotations

import numpy as np


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of greatest total gain, each row and column at most once."""
    if gain.size == 0:
        return []
    turned = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if turned else gain).astype(float)
    n, m = cost.shape
    row_potential, column_potential = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], column = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[column] = True
            row = owner[column]
            slack = cost[row - 1] - row_potential[row] - column_potential[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better] = slack[better]
            way[1:][better] = column
            open_ = np.where(used[1:], np.inf, least[1:])
            following = int(open_.argmin()) + 1
            delta = open_[following - 1]
            row_potential[owner[used]] += delta
            column_potential[used] -= delta
            least[1:][~used[1:]] -= delta
            column = following
            if owner[column] == 0:
                break
        while column:
            owner[column] = owner[way[column]]
            column = way[column]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((j, i) if turned else (i, j) for i, j in pairs)

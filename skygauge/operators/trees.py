"""Trees as plain arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROWS_AT_ONCE = 2048
CELLS_AT_ONCE = 65_536


def tree_groups(sizes: dict[int, int], most: int) -> list[tuple[int, int]]:
    """(first, last) of runs of trees with about ``most`` nodes; a larger tree is a group."""
    groups, nodes = [], 0
    for tree in sorted(sizes):
        if groups and nodes + sizes[tree] <= most:
            groups[-1] = (groups[-1][0], tree)
            nodes += sizes[tree]
        else:
            groups.append((tree, tree))
            nodes = sizes[tree]
    return groups


@dataclass
class TreeScorer:
    """All nodes of some trees in one set of arrays; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    depth: int

    def __post_init__(self):
        #: Right and left child of each node, side by side.
        self.children = np.column_stack([self.right, self.left]).ravel()

    def predict(self, x: np.ndarray) -> np.ndarray:
        parts = [x[i : i + ROWS_AT_ONCE] for i in range(0, len(x), ROWS_AT_ONCE)]
        return np.concatenate([self._predict(p) for p in parts]) if parts else np.empty(0)

    def _predict(self, x: np.ndarray) -> np.ndarray:
        values = np.empty((len(x), len(self.roots)))
        step = max(1, CELLS_AT_ONCE // max(1, len(self.roots)))
        for i in range(0, len(x), step):
            values[i : i + step] = self._reached(x[i : i + step])
        return values @ self.weights

    def _reached(self, x: np.ndarray) -> np.ndarray:
        """Values of the leaves (rows x trees); so few rows that all arrays of a step stay near the core."""
        flat, start = np.ascontiguousarray(x).ravel(), (np.arange(len(x)) * x.shape[1])[:, None]
        node = np.repeat(self.roots[None, :].astype(np.int64), len(x), axis=0)
        for _ in range(self.depth):
            low = flat.take(self.feature.take(node) + start) <= self.threshold.take(node)
            node = self.children.take(2 * node + low)
        return self.value.take(node)

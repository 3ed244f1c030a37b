"""Trees as plain arrays, for scoring batches inside a task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

@dataclass
class Ensemble:
    """Weighted trees over numeric features; -1 in ``left`` marks a leaf."""

    tree: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weights: np.ndarray
    base: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        roots = np.searchsorted(self.tree, np.arange(len(self.weights)))
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root, weight in zip(roots, self.weights):
            node = np.full(len(x), root)
            while True:
                inner = self.left[node] >= 0
                if not inner.any():
                    break
                goes_left = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(inner, np.where(goes_left, self.left[node], self.right[node]), node)
            total += weight * self.value[node]
        return total


def ensemble(trees: list[list[tuple]], weights: list[float], base: float = 0.0) -> Ensemble:
    columns: list[list] = [[], [], [], [], [], []]
    for number, nodes in enumerate(trees):
        offset = len(columns[0])
        for feature, threshold, left, right, value in nodes:
            row = (number, feature, threshold, left + offset if left >= 0 else -1, right + offset if right >= 0 else -1, value)
            for column, item in zip(columns, row):
                column.append(item)
    tree, feature, threshold, left, right, value = (np.array(c) for c in columns)
    return Ensemble(tree, feature, threshold, left, right, value, np.array(weights, dtype=float), base)

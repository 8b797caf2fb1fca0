"""A small random forest in numpy: Gini splits on quantile cuts, bagged rows, random features."""

from __future__ import annotations

import numpy as np


class Forest:
    def __init__(self, trees: int = 40, depth: int = 9, leaf: int = 3, seed: int = 7):
        self.trees, self.depth, self.leaf, self.seed = trees, depth, leaf, seed
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature (-1: leaf), cut, value; children 2i+1, 2i+2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        tried = max(1, round(x.shape[1] ** 0.5) + 1)
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 33), method="nearest")) for f in range(x.shape[1])]
        for _ in range(self.trees):
            size = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            rows = {0: rng.integers(0, len(y), len(y))}
            for i in range(size):
                r = rows.pop(i, None)
                if r is None:
                    continue
                value[i] = y[r].mean()
                if i >= size // 2 or len(r) < 2 * self.leaf or value[i] in (0.0, 1.0):
                    continue
                best = (1e-12, -1, 0.0)
                base = value[i] * (1 - value[i])
                for f in rng.choice(x.shape[1], tried, replace=False):
                    above = x[r, f][:, None] > cuts[f][None, :]
                    n = above.sum(axis=0)
                    ok = (n >= self.leaf) & (len(r) - n >= self.leaf)
                    if not ok.any():
                        continue
                    p = (above * y[r][:, None]).sum(axis=0)
                    a, b = p / np.maximum(n, 1), (y[r].sum() - p) / np.maximum(len(r) - n, 1)
                    gain = np.where(ok, base - (n * a * (1 - a) + (len(r) - n) * b * (1 - b)) / len(r), -1.0)
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (gain[j], f, cuts[f][j])
                if best[1] >= 0:
                    feature[i], cut[i] = best[1], best[2]
                    up = x[r, best[1]] > best[2]
                    rows[2 * i + 1], rows[2 * i + 2] = r[~up], r[up]
            self.nodes.append((feature, cut, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                go = f >= 0
                up = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
                at = np.where(go, 2 * at + 1 + up, at)
            out += value[at]
        return out / max(1, len(self.nodes))

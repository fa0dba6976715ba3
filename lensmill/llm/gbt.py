"""Gradient-boosted regression trees on binned features, kept as flat numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees end to end. A node with ``feature`` -1 is a leaf; ``left`` and ``right`` are node numbers."""

    base: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray, rows_at_once: int = 20_000) -> np.ndarray:
        """Predictions for the rows of ``x``: every tree of every row descends one level per step."""
        out = np.empty(len(x))
        for lo in range(0, len(x), rows_at_once):
            part = x[lo : lo + rows_at_once]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                f = self.feature[at]
                goes_left = part[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(f < 0, at, np.where(goes_left, self.left[at], self.right[at]))
            out[lo : lo + len(part)] = self.base + self.value[at].sum(axis=1)
        return out


def train(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 128, least: int = 8) -> Trees:
    """Least-squares boosting. ``monotone[f]`` is +1 or -1 if the prediction must not fall or rise in feature f, else 0.

    A split that breaks a constraint is refused, and the two halves of an allowed one are bounded by
    the middle of their values, so the constraint holds for whole trees and hence for their sum.
    """
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(k)]
    codes = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(k)], axis=1)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    base = float(y.mean()) if n else 0.0
    current = np.full(n, base)

    def node() -> int:
        feature.append(-1), threshold.append(0.0), left.append(0), right.append(0), value.append(0.0)
        return len(feature) - 1

    def grow(at: int, rows: np.ndarray, residual: np.ndarray, level: int, low: float, high: float) -> None:
        mean = float(np.clip(residual[rows].mean(), low, high)) if len(rows) else 0.0
        value[at] = rate * mean
        best = None
        if level < depth and len(rows) >= 2 * least:
            total, count = residual[rows].sum(), len(rows)
            for f in range(k):
                if not len(edges[f]):
                    continue
                c = codes[rows, f]
                counts = np.cumsum(np.bincount(c, minlength=len(edges[f]) + 1))[:-1]
                sums = np.cumsum(np.bincount(c, weights=residual[rows], minlength=len(edges[f]) + 1))[:-1]
                ok = (counts >= least) & (count - counts >= least)
                if not ok.any():
                    continue
                a, b = sums / np.maximum(counts, 1), (total - sums) / np.maximum(count - counts, 1)
                ok &= (b - a) * monotone[f] >= 0
                gain = np.where(ok, sums * a + (total - sums) * b, -np.inf)
                i = int(np.argmax(gain))
                if ok[i] and (best is None or gain[i] > best[0]):
                    best = (gain[i], f, i, float(np.clip(a[i], low, high)), float(np.clip(b[i], low, high)))
            if best is not None and best[0] <= total * total / count + 1e-12:
                best = None
        if best is None:
            current[rows] += value[at]
            return
        _, f, i, a, b = best
        middle = (a + b) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[f]]
        feature[at], threshold[at] = f, float(edges[f][i])
        goes_left = codes[rows, f] <= i
        left[at], right[at] = node(), node()
        grow(left[at], rows[goes_left], residual, level + 1, *bounds[0])
        grow(right[at], rows[~goes_left], residual, level + 1, *bounds[1])

    for _ in range(trees if n else 0):
        residual = y - current
        roots.append(node())
        grow(roots[-1], np.arange(n), residual, 0, -np.inf, np.inf)
    as_int = lambda v: np.array(v, dtype=np.int32)
    return Trees(base, depth, as_int(roots), as_int(feature), np.array(threshold), as_int(left), as_int(right), np.array(value))

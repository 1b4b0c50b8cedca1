"""Gradient-boosted trees with monotonic constraints, fitted and scored with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees in flat node arrays. Trees are complete: node k has the children 2k + 1 and
    2k + 2, so scoring takes one vectorised step per level for all trees and rows."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes): left if value <= threshold
    value: np.ndarray  # (trees, leaves)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability per row of ``x``. NaN goes right."""
        trees, inner = self.feature.shape
        raw = np.full(len(x), self.base)
        for t in range(trees):
            node = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                v = x[np.arange(len(x)), self.feature[t, node]]
                node = 2 * node + 1 + ~(v <= self.threshold[t, node])
            raw += self.value[t, node - inner]
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: np.ndarray,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.15,
    bins: int = 64,
    ridge: float = 1.0,
    least_rows: int = 8,
) -> Forest:
    """Logistic boosting on quantile bins.

    ``monotone`` has 1, -1 or 0 per feature. A split of a constrained feature needs leaf
    values in that order, and the middle of both bounds all values below it, so every tree
    and hence their sum is monotone in that feature.
    """
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(f)], axis=1)
    width = bins + 1
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    raw = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        at = np.zeros(n, np.int64)
        for k in range(inner):
            rows = np.flatnonzero(at == k)
            best = _split(binned[rows], g[rows], h[rows], width, monotone, ridge, least_rows, low[k], high[k])
            left, right = 2 * k + 1, 2 * k + 2
            low[left], low[right], high[left], high[right] = low[k], low[k], high[k], high[k]
            if best is None:
                at[rows] = left
                continue
            j, b, middle = best
            feature[k], threshold[k] = j, cuts[j][b]
            if monotone[j]:
                up, down = (left, right) if monotone[j] > 0 else (right, left)
                high[up], low[down] = middle, middle
            at[rows] = np.where(binned[rows, j] <= b, left, right)
        leaf = at - inner
        sums_g, sums_h = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        value = rate * np.clip(-sums_g / (sums_h + ridge), low[inner:], high[inner:])
        value[np.bincount(leaf, minlength=leaves) == 0] = 0
        raw += value[leaf]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), base)


def _split(binned, g, h, width, monotone, ridge, least_rows, low, high):
    """(feature, bin, middle value) of the best allowed split, or None."""
    f = binned.shape[1]
    if len(g) < 2 * least_rows:
        return None
    key = (binned + np.arange(f) * width).ravel()
    grid = lambda w: np.bincount(key, w, f * width).reshape(f, width).cumsum(axis=1)
    gl, hl, nl = grid(np.repeat(g, f)), grid(np.repeat(h, f)), grid(np.ones(len(key)))
    gr, hr, nr = gl[:, -1:] - gl, hl[:, -1:] - hl, nl[:, -1:] - nl
    vl = np.clip(-gl / (hl + ridge), low, high)
    vr = np.clip(-gr / (hr + ridge), low, high)
    gain = -(gl * vl + (hl + ridge) * vl**2 / 2) - (gr * vr + (hr + ridge) * vr**2 / 2)
    whole = np.clip(-g.sum() / (h.sum() + ridge), low, high)
    gain += g.sum() * whole + (h.sum() + ridge) * whole**2 / 2
    wrong = ((vr - vl) * monotone[:, None]) < 0
    gain[wrong | (nl < least_rows) | (nr < least_rows)] = -np.inf
    j, b = np.unravel_index(np.argmax(gain), gain.shape)
    return (j, b, (vl[j, b] + vr[j, b]) / 2) if gain[j, b] > 1e-9 else None

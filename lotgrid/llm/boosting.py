"""Gradient-boosted trees for a 0/1 label: fitted on weighted binned rows, flattened into numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth, node by node in level order: row t of each array is a tree.

    A row goes to child 2k + 2 of node k if its feature is above the threshold, else to 2k + 1; leaves come after the
    inner nodes. The score is 1 / (1 + exp(-(base + sum of leaves))).
    """

    depth: int
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += v[at - len(f)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, monotone: dict[int, int] | None = None, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 2.0, least: float = 8.0) -> Trees:
    """Logistic loss, histogram splits. monotone: feature -> +1 (score never falls as it grows) or -1 (never rises).

    A constrained split must order its children's values, and their descendants stay on their side of the middle, so
    every tree, and the sum, is monotone. Rows without any label of one kind give a constant score.
    """
    n, width = x.shape
    w = np.ones(n) if weight is None else weight.astype(float)
    sign = np.zeros(width, int)
    for k, v in (monotone or {}).items():
        sign[k] = v
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(1) for k in range(width)]
    size = max(len(e) for e in edges) + 1
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1)  # bin b: above edge b - 1
    inner, share = 2**depth - 1, np.clip(np.average(y, weights=w) if n and w.sum() else 0.5, 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(rounds if n else 0):
        p = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
        g, h = w * (p - y), w * np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * width + np.arange(width)) * size + binned
            shape = (nodes, width, size)
            sums = [np.bincount(cell.ravel(), np.repeat(v, width), minlength=nodes * width * size).reshape(shape).cumsum(axis=2) for v in (g, h)]
            gl, hl = sums
            gr, hr = gl[:, :, -1:] - gl, hl[:, :, -1:] - hl
            lo, hi = low[first : first + nodes, None, None], high[first : first + nodes, None, None]
            vl, vr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-gr / (hr + ridge), lo, hi)
            gain = -(gl * vl + (hl + ridge) * vl**2 / 2) - (gr * vr + (hr + ridge) * vr**2 / 2)
            v0 = np.clip(-gl[:, :, -1:] / (hl[:, :, -1:] + ridge), lo, hi)
            gain += gl[:, :, -1:] * v0 + (hl[:, :, -1:] + ridge) * v0**2 / 2
            bad = (np.minimum(hl, hr) < least * 0.05) | (sign[None, :, None] * (vr - vl) < 0)
            for k, e in enumerate(edges):
                bad[:, k, len(e) :] = True
            gain[bad] = -np.inf
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for j in range(nodes):
                k, cut = divmod(int(best[j]), size)
                node = first + j
                if gain[j, k, cut] > 1e-6:
                    feature[node], threshold[node] = k, edges[k][cut]
                left, right = 2 * node + 1, 2 * node + 2
                low[left] = low[right] = low[node]
                high[left] = high[right] = high[node]
                if np.isfinite(threshold[node]) and sign[k]:
                    middle = (vl[j, k, cut] + vr[j, k, cut]) / 2
                    if sign[k] > 0:
                        high[left] = low[right] = middle
                    else:
                        low[left] = high[right] = middle
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        spot = at - inner
        gs, hs = (np.bincount(spot, v, minlength=inner + 1) for v in (g, h))
        leaf = rate * np.clip(-gs / (hs + ridge), low[inner:], high[inner:])
        leaf[np.bincount(spot, minlength=inner + 1) == 0] = rate * np.clip(0, low[inner:], high[inner:])[np.bincount(spot, minlength=inner + 1) == 0]
        margin += leaf[spot]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    shape = (len(leaves), inner)
    return Trees(depth, base, np.array(features, np.int64).reshape(shape), np.array(thresholds).reshape(shape), np.array(leaves).reshape(len(leaves), inner + 1))

"""Gradient-boosted regression trees with logistic loss, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: for each inner node a feature and a cut (go right above it), for each leaf a value."""

    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        for f, c, v in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner and at[:1].size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += v[at - inner]
        return total


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, least: float = 2.0) -> Trees:
    """Boosted trees for labels 0 and 1; with one class or no rows the base rate alone."""
    inner, n_leaves = (1 << depth) - 1, 1 << depth
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, n_leaves)), base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    odds, out = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        grad, hess = y - p, p * (1 - p) + 1e-9
        at, f, c = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            local = at - first
            g, h = np.zeros((nodes, x.shape[1], BINS)), np.zeros((nodes, x.shape[1], BINS))
            for k in range(x.shape[1]):
                key = local * BINS + binned[:, k]
                g[:, k], h[:, k] = (np.bincount(key, v, nodes * BINS).reshape(nodes, BINS) for v in (grad, hess))
            gl, hl = np.cumsum(g, 2), np.cumsum(h, 2)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(hl < least) | (ht - hl < least)] = -1
            best = gain.reshape(nodes, -1).argmax(1)
            for n in range(nodes):
                k, b = divmod(int(best[n]), BINS)
                if gain[n, k, b] > 1e-9 and b < len(edges[k]):
                    f[first + n], c[first + n] = k, edges[k][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), f[at]] > c[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, grad, n_leaves) / (np.bincount(leaf, hess, n_leaves) + 1)
        odds += value[leaf]
        out.append((f, c, value))
    return Trees(*(np.stack(v) for v in zip(*out, strict=True)), base)

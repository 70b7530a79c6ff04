"""Gradient boosted regression trees with logistic loss, small enough to train in a moment and to ship in a closure."""

from __future__ import annotations

import numpy as np


def _grow(x, grad, hess, rows, depth, min_hess, shrink, tree) -> int:
    """Append the subtree for ``rows`` to ``tree`` (feature, cut, left, right, value) and return its place."""
    place = len(tree)
    g, h = grad[rows].sum(), hess[rows].sum()
    tree.append([-1, 0.0, 0, 0, -shrink * g / (h + 1.0)])
    best = (1e-6, -1, 0.0)
    if depth and len(rows) > 1:
        for f in range(x.shape[1]):
            values = x[rows, f]
            order = np.argsort(values, kind="stable")
            v, gs, hs = values[order], np.cumsum(grad[rows][order]), np.cumsum(hess[rows][order])
            gl, hl = gs[:-1], hs[:-1]
            ok = (v[1:] > v[:-1]) & (hl >= min_hess) & (h - hl >= min_hess)
            if ok.any():
                gain = np.where(ok, gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1), 0)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), f, float(v[i] + v[i + 1]) / 2)
    if best[1] >= 0:
        under = x[rows, best[1]] <= best[2]
        left = _grow(x, grad, hess, rows[under], depth - 1, min_hess, shrink, tree)
        right = _grow(x, grad, hess, rows[~under], depth - 1, min_hess, shrink, tree)
        tree[place][:4] = best[1], best[2], left, right
    return place


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, shrink: float = 0.2, min_hess: float = 1.0):
    """A model of ``trees`` trees on rows x and labels 0/1 y."""
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin, model = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree: list[list[float]] = []
        _grow(x, p - y, p * (1 - p), np.arange(len(y)), depth, min_hess, shrink, tree)
        model.append(np.array(tree))
        margin += _apply(model[-1], x)
    return base, model


def _apply(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    while (inner := tree[at, 0] >= 0).any():
        f = np.maximum(tree[at, 0], 0).astype(np.int64)
        step = np.where(x[np.arange(len(x)), f] <= tree[at, 1], tree[at, 2], tree[at, 3]).astype(np.int64)
        at = np.where(inner, step, at)
    return tree[at, 4]


def predict(model, x: np.ndarray) -> np.ndarray:
    """Probabilities of label 1."""
    base, trees = model
    margin = np.full(len(x), base)
    for tree in trees:
        margin += _apply(tree, x)
    return 1 / (1 + np.exp(-margin))

"""Isotonic calibration over a fixed grid of raw scores, from counts that partitions can sum."""

from __future__ import annotations

import numpy as np

BINS = 2000


def bin_of(raw: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip(((raw - low) / max(high - low, 1e-12) * BINS).astype(np.int64), 0, BINS - 1)


def isotonic(n: np.ndarray, positive: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots (raw score, probability) of the non-decreasing fit to ``positive`` of ``n`` in each bin.

    Neighbours that fall are pooled; each pool counts half a case of either label, which keeps scores off 0 and 1.
    """
    centre = low + (np.arange(BINS) + 0.5) * (high - low) / BINS
    pools: list[list[float]] = []  # cases, positives, sum of raw scores
    for k in np.flatnonzero(n):
        pools.append([float(n[k]), float(positive[k]), float(n[k] * centre[k])])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    if not pools:
        return np.array([0.0]), np.array([0.5])
    x = np.array([p[2] / p[0] for p in pools])
    y = np.maximum.accumulate(np.array([(p[1] + 0.5) / (p[0] + 1) for p in pools]))
    return x, y


def apply(knots: tuple[np.ndarray, np.ndarray], raw: np.ndarray) -> np.ndarray:
    return np.clip(np.interp(raw, *knots), 0.0, 1.0)

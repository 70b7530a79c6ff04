"""Inference in linear-chain conditional random fields with two labels."""

from __future__ import annotations

import numpy as np


def forward_backward(unary: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For chains unary[n, steps] (log-odds of label 1 against 0; nan past the end) and log transitions trans[2, 2]:

    marginals of label 1, expected transitions [n, 2, 2], log partition functions.
    """
    n, steps = unary.shape
    ok = ~np.isnan(unary)
    u = np.where(ok, unary, 0.0)
    forward = np.zeros((steps, n, 2))
    forward[0, :, 1] = u[:, 0]
    backward = np.zeros((steps, n, 2))
    for t in range(1, steps):
        a = forward[t - 1]
        step = np.stack([np.logaddexp(a[:, 0] + trans[0, k], a[:, 1] + trans[1, k]) for k in (0, 1)], 1)
        step[:, 1] += u[:, t]
        forward[t] = np.where(ok[:, t, None], step, a)
    for t in range(steps - 2, -1, -1):
        b = backward[t + 1]
        ahead = np.stack([b[:, 0], b[:, 1] + u[:, t + 1]], 1)
        step = np.stack([np.logaddexp(trans[j, 0] + ahead[:, 0], trans[j, 1] + ahead[:, 1]) for j in (0, 1)], 1)
        backward[t] = np.where(ok[:, t + 1, None], step, b)
    whole = np.logaddexp(forward[-1, :, 0], forward[-1, :, 1])
    marginal = np.exp(forward[:, :, 1] + backward[:, :, 1] - whole).T
    moves = np.zeros((n, 2, 2))
    for j in (0, 1):
        for k in (0, 1):
            e = forward[:-1, :, j] + trans[j, k] + backward[1:, :, k] + (u[:, 1:].T if k else 0) - whole
            moves[:, j, k] = np.where(ok[:, 1:].T, np.exp(np.minimum(e, 0)), 0).sum(0)
    return np.where(ok, marginal, 0), moves, whole


def chained_marginals(unary: np.ndarray, trans: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Marginals of label 1 where consecutive rows of one owner are one chain; arguments as for :func:`forward_backward`.

    A row's transfer matrix carries the forward message over it and the backward message back, so messages pass from row to
    row of a chain, and then, in all rows together, from token to token. Only the last row of a chain may be filled in part.
    Messages are scaled numbers, not logarithms: two labels lose nothing by it.
    """
    n, steps = unary.shape
    ok = ~np.isnan(unary)
    weight = np.exp(np.clip(np.where(ok, unary, 0.0), -60, 60))
    move = np.exp(trans - trans.max())
    starts = np.append(True, owner[1:] != owner[:-1])
    # The first token of a chain has no transition before it.
    first = np.where(starts[:, None, None], np.eye(2), move)
    place = np.arange(n)
    rank = place - np.maximum.accumulate(np.where(starts, place, 0))
    into, out_of = np.ones((n, 2)), np.ones((n, 2))
    if rank.any():
        over = np.tile(np.eye(2), (n, 1, 1))
        for t in range(steps):
            step = over @ (first if t == 0 else move)
            step[:, :, 1] *= weight[:, t, None]
            over = np.where(ok[:, t, None, None], step / step.sum((1, 2), keepdims=True), over)
        of_rank = np.split(np.argsort(rank, kind="stable"), np.cumsum(np.bincount(rank))[:-1])
        for rows in of_rank[1:]:
            message = np.einsum("ij,ijk->ik", into[rows - 1], over[rows - 1])
            into[rows] = message / message.sum(1, keepdims=True)
        for rows in of_rank[:0:-1]:
            message = np.einsum("ijk,ik->ij", over[rows], out_of[rows])
            out_of[rows - 1] = message / message.sum(1, keepdims=True)
    forward = np.empty((steps, n, 2))
    at = into
    for t in range(steps):
        step = np.einsum("ij,ijk->ik", at, first) if t == 0 else at @ move
        step[:, 1] *= weight[:, t]
        at = forward[t] = np.where(ok[:, t, None], step / step.sum(1, keepdims=True), at)
    marginal = np.empty((n, steps))
    behind = out_of
    for t in range(steps - 1, -1, -1):
        both = forward[t] * behind
        marginal[:, t] = both[:, 1] / both.sum(1)
        step = (behind * np.stack([np.ones(n), weight[:, t]], 1)) @ move.T
        behind = np.where(ok[:, t, None], step / step.sum(1, keepdims=True), behind)
    return np.where(ok, marginal, 0)


def viterbi(unary: list[float], trans: list[list[float]]) -> list[int]:
    """The most likely labels of one chain; of equally likely ones, those with label 0 last."""
    if not unary:
        return []
    zero, one = 0.0, unary[0]
    back = []
    for u in unary[1:]:
        from_zero, from_one = int(one + trans[1][0] > zero + trans[0][0]), int(one + trans[1][1] > zero + trans[0][1])
        back.append((from_zero, from_one))
        zero, one = (
            (one + trans[1][0]) if from_zero else (zero + trans[0][0]),
            ((one + trans[1][1]) if from_one else (zero + trans[0][1])) + u,
        )
    label = int(one > zero)
    labels = [label]
    for step in reversed(back):
        label = step[label]
        labels.append(label)
    return labels[::-1]

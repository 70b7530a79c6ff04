"""Cheapest paths through four states by divide and conquer, in linear space.

A step says, for a state before it and one after it, the least cost and the text of that move. Texts of two moves from one
state are never prefixes of each other, so among the cheapest paths the one with the least text is found from ranks alone:
a path that is ahead stays ahead. Costs and ranks of the four states are all that is kept while walking; the walk from
the start and the walk from the goal meet in the middle, and both halves are solved in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import inf

STATES = 4
# (state before, state after, cost, text or rank of the move among those from the same state)
Step = tuple[tuple[int, int, int, object], ...]


def forward(steps: Sequence[Step], low: int, high: int, start: int) -> tuple[list[float], list[int]]:
    """For each state after steps[low:high] from ``start``: the least cost, and the rank of the least text of that cost."""
    cost: list[float] = [inf] * STATES
    rank = [0] * STATES
    cost[start] = 0
    for i in range(low, high):
        best: list[tuple | None] = [None] * STATES
        for before, after, price, text in steps[i]:
            c = cost[before] + price
            if c < inf:
                way = (c, rank[before], text)
                if best[after] is None or way < best[after]:
                    best[after] = way
        order = sorted((way[1:], s) for s, way in enumerate(best) if way)
        cost = [inf if way is None else way[0] for way in best]
        for place, (_, s) in enumerate(order):
            rank[s] = place
    return cost, rank


def backward(steps: Sequence[Step], low: int, high: int, goal: int) -> list[float]:
    """For each state before steps[low:high]: the least cost to ``goal``."""
    cost: list[float] = [inf] * STATES
    cost[goal] = 0
    for i in range(high - 1, low - 1, -1):
        new: list[float] = [inf] * STATES
        for before, after, price, _ in steps[i]:
            new[before] = min(new[before], price + cost[after])
        cost = new
    return cost


def moves(steps: Sequence[Step], start: int, goal: int) -> list[tuple[int, int, int, object]]:
    """The move taken at each step of the cheapest path from ``start`` to ``goal``, of the least text among equals."""
    out: list = [None] * len(steps)
    todo = [(0, len(steps), start, goal)]
    while todo:
        low, high, first, last = todo.pop()
        if high - low == 1:
            out[low] = min((m for m in steps[low] if m[0] == first and m[1] == last), key=lambda m: m[2:])
        elif high > low:
            middle = (low + high) // 2
            cost, rank = forward(steps, low, middle, first)
            rest = backward(steps, middle, high, last)
            crossing = min(range(STATES), key=lambda s: (cost[s] + rest[s], rank[s]))
            todo += [(low, middle, first, crossing), (middle, high, crossing, last)]
    return out


def joined(steps: Sequence[Step]) -> Step:
    """All steps as one: a move for each pair of states that can be reached, with ranks in place of texts."""
    out = []
    for start in range(STATES):
        cost, rank = forward(steps, 0, len(steps), start)
        out += [(start, s, int(cost[s]), rank[s]) for s in range(STATES) if cost[s] < inf]
    return tuple(out)

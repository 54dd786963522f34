"""Optimal assignment: shortest augmenting paths, over a dense cost matrix or over a list of allowed pairs."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np

GATE = 1e5


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, min(rows, columns) of them, by row."""
    cost = np.asarray(cost, float)
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for new in range(n):
        reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, last, base = new, -1, 0.0
        while True:
            step = base + cost[row] - row_price[row] - column_price
            better = ~done & (step < reach)
            reach[better], via[better] = step[better], last
            column = int(np.argmin(np.where(done, np.inf, reach)))
            base = reach[column]
            done[column] = True
            last = column
            if owner[column] < 0:
                break
            row = owner[column]
        row_price[new] += base
        for c in np.flatnonzero(done):
            if c != last:
                row_price[owner[c]] += base - reach[c]
                column_price[c] -= base - reach[c]
        while last >= 0:
            before = via[last]
            owner[last] = new if before < 0 else owner[before]
            last = before
    return sorted((int(r), c) for c, r in enumerate(owner) if r >= 0)


def gated(cost: np.ndarray, allowed: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """As many allowed pairs as possible, then of least cost."""
    return [(r, c) for r, c in assign(np.where(allowed, cost, limit + GATE)) if allowed[r, c]]


def sparse(pairs: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Of these allowed pairs (row, column, cost): as many as possible, then of least cost, by row. What gated does,
    at the price of the pairs there are: each row may also stay alone, for more than all else can cost together."""
    if len(pairs) < 2:
        return [(r, c) for r, c, _ in pairs]
    near: dict[int, list[tuple[int, float]]] = {}
    for r, c, cost in pairs:
        near.setdefault(r, []).append((c, cost))
    costs = [cost for _, _, cost in pairs]
    alone = max(costs) + (max(costs) - min(costs)) * len(near) + 1.0
    row_price, column_price = dict.fromkeys(near, 0.0), {c: 0.0 for _, c, _ in pairs}
    owner: dict[int, int] = {}
    at: dict[int, int] = {}
    for new in near:
        step, taken, column = min([(cost - column_price[c], c in owner, c) for c, cost in near[new]])
        if not taken and step < alone:  # the nearest column is free: nothing to search
            owner[column], at[new], row_price[new] = new, column, step
            continue
        reach: dict[int, float] = {}
        via: dict[int, int] = {}
        done: list[int] = []
        ended: set[int] = set()
        heap: list[tuple[float, int, int, int]] = []
        row, base = new, 0.0
        while True:
            price = base - row_price[row]
            heappush(heap, (price + alone, 2, row, row))
            for c, cost in near[row]:
                if c not in ended:
                    step = price + cost - column_price[c]
                    if c not in reach or step < reach[c]:
                        reach[c] = step
                        via[c] = row
                        heappush(heap, (step, int(c in owner), c, row))  # of equally near columns, free ones first
            while True:
                base, kind, column, row = heappop(heap)
                if kind == 2 or column not in ended:
                    break
            if kind != 1:
                break
            ended.add(column)
            done.append(column)
            row = owner[column]
        row_price[new] += base
        for c in done:
            row_price[owner[c]] += base - reach[c]
            column_price[c] -= base - reach[c]
        last = None if kind == 2 else column
        while True:  # back to the new row: each row leaves its column to the one before it
            before = at.pop(row, None)
            if last is not None:
                owner[last], at[row] = row, last
            if row == new:
                break
            last, row = before, via[before]
    return sorted(at.items())

"""Small assignment solvers used inside tasks; Spark forms the groups.

Everything here works on one connected component of a bipartite graph.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable

import numpy as np

TIE = 5e-10


def components(edges: Iterable[tuple[Hashable, Hashable]]) -> list[list[int]]:
    """Indices of the edges of each connected component."""
    parent: dict = {}

    def root(node):
        parent.setdefault(node, node)
        while parent[node] != node:
            parent[node] = parent[parent[node]]
            node = parent[node]
        return node

    edges = list(edges)
    for left, right in edges:
        a, b = root(("l", left)), root(("r", right))
        if a != b:
            parent[a] = b
    groups: dict = {}
    for index, (left, _) in enumerate(edges):
        groups.setdefault(root(("l", left)), []).append(index)
    return list(groups.values())


def best_total(weights: np.ndarray) -> tuple[float, list[int]]:
    """Maximum-weight matching with unmatched rows allowed; absent edges are negative.

    Returns the total and, per row, the column or -1. Shortest augmenting paths
    with potentials over costs padded by one zero dummy per row.
    """
    rows, cols = weights.shape
    cost = np.concatenate([np.where(weights > 0, -weights, 0.0), np.zeros((rows, rows))], axis=1)
    width = cols + rows
    u, v = np.zeros(rows + 1), np.zeros(width + 1)
    owner = np.zeros(width + 1, dtype=int)
    for row in range(1, rows + 1):
        owner[0] = row
        column = 0
        slack = np.full(width + 1, np.inf)
        back = np.zeros(width + 1, dtype=int)
        seen = np.zeros(width + 1, dtype=bool)
        while True:
            seen[column] = True
            current = owner[column]
            reduced = cost[current - 1] - u[current] - v[1:]
            better = (~seen[1:]) & (reduced < slack[1:])
            slack[1:][better] = reduced[better]
            back[1:][better] = column
            open_slack = np.where(seen[1:], np.inf, slack[1:])
            nearest = int(np.argmin(open_slack)) + 1
            delta = open_slack[nearest - 1]
            u[owner[seen]] += delta
            v[seen] -= delta
            slack[~seen] -= delta
            column = nearest
            if owner[column] == 0:
                break
        while column:
            previous = back[column]
            owner[column] = owner[previous]
            column = previous
    chosen = [-1] * rows
    for column in range(1, width + 1):
        row = owner[column]
        if row and column <= cols and weights[row - 1, column - 1] > 0:
            chosen[row - 1] = column - 1
    total = float(sum(weights[r, c] for r, c in enumerate(chosen) if c >= 0))
    return total, chosen


def _by_table(weights: np.ndarray) -> list[int]:
    """Best matching by dynamic programming over used columns; ties go to the smallest list."""
    rows, _ = weights.shape
    options = [[int(c) for c in np.flatnonzero(weights[r] > 0)] for r in range(rows)]
    memo: dict = {}

    def solve(row: int, used: int) -> tuple[float, tuple]:
        if row == rows:
            return 0.0, ()
        key = (row, used)
        if key in memo:
            return memo[key]
        best_value, best_choice = -1.0, ()
        for column in [*options[row], -1]:  # a match sorts before leaving the row open
            if column >= 0 and used >> column & 1:
                continue
            rest, picks = solve(row + 1, used | (1 << column) if column >= 0 else used)
            value = rest + (weights[row, column] if column >= 0 else 0.0)
            if value > best_value + TIE:
                best_value, best_choice = value, (column, *picks)
        memo[key] = (best_value, best_choice)
        return memo[key]

    return list(solve(0, 0)[1])


def best_matching(weights: np.ndarray) -> list[int]:
    """Best matching with deterministic ties: smallest columns for the earliest rows."""
    rows, cols = weights.shape
    if rows <= 12 and cols <= 12:
        return _by_table(weights)
    target, chosen = best_total(weights)
    left = weights.copy()
    fixed: list[int] = []
    gained = 0.0
    for row in range(rows):
        pick = -1
        for column in np.flatnonzero(left[row] > 0):
            rest = np.delete(left[row + 1:], column, axis=1)
            value = gained + left[row, column] + (best_total(rest)[0] if len(rest) and rest.shape[1] else 0.0)
            if value >= target - TIE:
                pick = int(column)
                break
        fixed.append(pick)
        if pick >= 0:
            gained += float(weights[row, pick])
            left[:, pick] = -1.0
    return fixed


def match_edges(left: list, right: list, weight: list) -> list[int]:
    """Indices of the edges of the best one-to-one matching, component by component."""
    kept: list[int] = []
    for group in components(zip(left, right)):
        if len(group) == 1:
            kept.append(group[0])
            continue
        rows = sorted({left[i] for i in group})
        cols = sorted({right[i] for i in group})
        at = {name: i for i, name in enumerate(rows)}, {name: i for i, name in enumerate(cols)}
        table = np.full((len(rows), len(cols)), -1.0)
        edge = {}
        for i in group:
            cell = at[0][left[i]], at[1][right[i]]
            table[cell] = weight[i]
            edge[cell] = i
        kept += [edge[(r, c)] for r, c in enumerate(best_matching(table)) if c >= 0]
    return sorted(kept)

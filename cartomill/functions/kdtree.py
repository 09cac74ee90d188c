"""A small k-d tree over numpy arrays: fixed-radius pairs, cells and halos."""

from __future__ import annotations

import numpy as np

LEAF = 48


class KdTree:
    """Median splits on the widest axis; queries of many points go down together."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf

    def pairs(self, queries: np.ndarray, radius: float):
        """Yield (query indices, point indices) of pairs at most radius apart, in pieces."""
        if not len(self.points) or not len(queries):
            return
        stack = [(np.arange(len(self.points)), np.arange(len(queries)))]
        while stack:
            own, asked = stack.pop()
            pts = self.points[own]
            low, high = pts.min(axis=0), pts.max(axis=0)
            q = queries[asked]
            gap = np.maximum(0.0, np.maximum(low - q, q - high))
            keep = (gap * gap).sum(axis=1) <= radius * radius
            asked = asked[keep]
            if not len(asked):
                continue
            if len(own) <= self.leaf or (high == low).all():
                step = max(1, 2_000_000 // len(own))
                for i in range(0, len(asked), step):
                    part = asked[i : i + step]
                    d = np.zeros((len(part), len(own)))
                    for axis in range(pts.shape[1]):
                        d += (queries[part, axis][:, None] - pts[:, axis][None, :]) ** 2
                    a, b = np.nonzero(d <= radius * radius)
                    yield part[a], own[b]
                continue
            axis = int(np.argmax(high - low))
            half = len(own) // 2
            order = np.argpartition(pts[:, axis], half)
            stack.append((own[order[:half]], asked))
            stack.append((own[order[half:]], asked))


def fit_cells(sample: np.ndarray, cells: int) -> list[tuple]:
    """Splits of about ``cells`` equal cells: nodes (axis, value, left, right), leaves (-1, cell)."""
    nodes: list[tuple] = []
    count = 0

    def build(pts: np.ndarray, want: int) -> int:
        nonlocal count
        at = len(nodes)
        nodes.append(())
        spread = np.ptp(pts, axis=0) if len(pts) else np.zeros(1)
        if want <= 1 or len(pts) < 2 or spread.max() == 0:
            nodes[at] = (-1, count)
            count += 1
            return at
        axis = int(np.argmax(spread))
        cut = float(np.median(pts[:, axis]))
        left = pts[:, axis] <= cut
        if left.all():
            cut = float(pts[:, axis][pts[:, axis] < cut].max())
            left = pts[:, axis] <= cut
        a = build(pts[left], want // 2)
        b = build(pts[~left], want - want // 2)
        nodes[at] = (axis, cut, a, b)
        return at

    build(sample, cells)
    return nodes


def assign(nodes: list[tuple], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) for every cell that the box low..high of a row meets."""
    rows, cells = [], []
    stack = [(0, np.arange(len(low)))]
    while stack:
        at, idx = stack.pop()
        if not len(idx):
            continue
        node = nodes[at]
        if node[0] == -1:
            rows.append(idx)
            cells.append(np.full(len(idx), node[1]))
            continue
        axis, cut, a, b = node
        stack.append((a, idx[low[idx, axis] <= cut]))
        stack.append((b, idx[high[idx, axis] > cut]))
    if not rows:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate(rows), np.concatenate(cells)

"""Vantage-point trees over 64-bit fingerprints under the Hamming distance."""

from __future__ import annotations

import numpy as np


def hamming(a: np.ndarray, b) -> np.ndarray:
    """Differing bits of unsigned 64-bit fingerprints."""
    return np.bitwise_count(a ^ b)


class Router:
    """The upper levels of a tree, fitted on a bounded sample; its leaves are shards.

    Each inner node has a vantage point and a radius. A fingerprint belongs to the one leaf
    that its distances lead to. A query of reach r must visit each leaf that its ball may
    overlap: inside if d - r <= radius, outside if d + r > radius (triangle inequality).
    """

    def __init__(self, sample: np.ndarray, leaves: int):
        self.points: list[int] = []
        self.radii: list[int] = []
        self.children: list[list[int]] = []  # >= 0: an inner node, else -1 - leaf
        self.leaves = 0
        self.root = self._grow(np.unique(sample), leaves)

    def _grow(self, sample: np.ndarray, leaves: int) -> int:
        if leaves > 1 and len(sample) >= 2:
            point = sample[len(sample) // 2]
            far = hamming(sample, point)
            radius = int(np.median(far))
            if (inside := far <= radius).all():
                radius -= 1
                inside = far <= radius
            if inside.any() and not inside.all():
                node = len(self.points)
                self.points.append(int(point))
                self.radii.append(radius)
                self.children.append([])
                # Both sides get leaves by their share of the sample.
                near = min(leaves - 1, max(1, round(leaves * inside.mean())))
                self.children[node] = [self._grow(sample[inside], near), self._grow(sample[~inside], leaves - near)]
                return node
        self.leaves += 1
        return -self.leaves

    def visits(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs: the leaves that each point's ball of this reach may overlap."""
        rows, found, open_ = [], [], [(self.root, np.arange(len(points)))]
        while open_:
            node, at = open_.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                found.append(np.full(len(at), -1 - node, np.int64))
                continue
            far = hamming(points[at], np.uint64(self.points[node])).astype(np.int64)
            open_.append((self.children[node][0], at[far - reach <= self.radii[node]]))
            open_.append((self.children[node][1], at[far + reach > self.radii[node]]))
        none = [np.empty(0, np.int64)]
        return np.concatenate(rows or none), np.concatenate(found or none)


#: Below so many points or queries, a node compares all of them.
BUCKET = 256


def close_pairs(data: np.ndarray, queries: np.ndarray, reach: int):
    """Yield (data rows, query rows) of all pairs within reach, by descending one tree over the data
    with all queries at once. Each vantage point is matched where it stands."""
    open_ = [(np.arange(len(data)), np.arange(len(queries)))]
    while open_:
        d, q = open_.pop()
        if not len(d) or not len(q):
            continue
        if len(d) <= BUCKET or len(q) <= 4:
            for lo in range(0, len(q), 4096):  # so many queries of a bucket are compared at once
                part = q[lo : lo + 4096]
                i, j = np.nonzero(hamming(data[d][:, None], queries[part][None, :]) <= reach)
                if len(i):
                    yield d[i], part[j]
            continue
        point = data[d[len(d) // 2]]
        far = hamming(data[d], point).astype(np.int64)
        radius = int(np.median(far))
        if (inside := far <= radius).all():
            radius -= 1
            inside = far <= radius
        away = hamming(queries[q], point).astype(np.int64)
        if inside.all() or not inside.any():  # distinct data cannot all be as far as the point itself
            radius = 0
            inside = far == 0
        open_.append((d[inside], q[away - reach <= radius]))
        open_.append((d[~inside], q[away + reach > radius]))


class Forest:
    """Union-find over the rows of a shard."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the sets of all pairs at once: hook the larger root under the smaller until nothing moves."""
        while True:
            a, b = self._roots(a), self._roots(b)
            open_ = a != b
            if not open_.any():
                return
            a, b = a[open_], b[open_]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def _roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if (y == x).all():
                return x
            self.up[x] = self.up[y]
            x = y

    def roots(self) -> np.ndarray:
        return self._roots(np.arange(len(self.up)))

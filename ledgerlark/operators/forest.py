"""Regression trees on one series' weekly rows: exact splits, bootstrap weights, nothing shared between series.

A forest is fitted by tasks of a few trees each, on a few hundred rows that are one series' training weeks.  Every
midpoint between two neighbouring values of a feature is a split candidate.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Sequence
from typing import NamedTuple

import numpy as np

LEAF = -1


class Trees(NamedTuple):
    """Nodes of several trees in one numbering: rows with ``x[feature] <= cut`` go to ``below``, others to ``below + 1``."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    value: np.ndarray

    def pack(self) -> bytes:
        sizes = np.array([len(self.roots), len(self.feature)], np.int32)
        return b"".join(np.ascontiguousarray(part).tobytes() for part in (sizes, *self))

    @classmethod
    def unpack(cls, data: bytes) -> Trees:
        trees, nodes = np.frombuffer(data, np.int32, 2)
        parts, at = [], 8
        for size, kind in zip((trees, nodes, nodes, nodes, nodes), (np.int32, np.int32, np.float64, np.int32, np.float64)):
            parts.append(np.frombuffer(data, kind, size, at))
            at += size * np.dtype(kind).itemsize
        return cls(*parts)

    @classmethod
    def joined(cls, parts: Sequence[Trees]) -> Trees:
        shift = np.cumsum([0, *(len(p.feature) for p in parts)])[:-1].astype(np.int32)
        return cls(np.concatenate([p.roots + n for p, n in zip(parts, shift)]), np.concatenate([p.feature for p in parts]),
                   np.concatenate([p.cut for p in parts]), np.concatenate([p.below + n for p, n in zip(parts, shift)]),
                   np.concatenate([p.value for p in parts]))

    def values(self, x: np.ndarray) -> np.ndarray:
        """Leaf values, a row per row of ``x`` and a column per tree."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        while (inner := self.feature[at] != LEAF).any():
            up = x[rows, np.where(inner, self.feature[at], 0)] > self.cut[at]
            at = np.where(inner, self.below[at] + up, at)
        return self.value[at]


def series_seed(seed: int, key: Sequence[str]) -> list[int]:
    """Seed of a series: other series do not change it."""
    return [seed, zlib.crc32("\x1f".join(key).encode())]


def bootstrap_weights(rows: int, tree: int, seed: Sequence[int]) -> np.ndarray:
    """How often each row is drawn for the tree."""
    rng = np.random.default_rng([*seed, tree])
    return np.bincount(rng.integers(0, rows, rows), minlength=rows).astype(float)


def grow_trees(x: np.ndarray, y: np.ndarray, trees: Iterable[int], seed: Sequence[int], min_leaf: int = 2) -> Trees:
    """The trees with the given numbers; a leaf holds ``min_leaf`` different rows at least."""
    order = np.argsort(x, axis=0, kind="stable").T  # a line per feature: rows by value
    nodes: list[list] = []
    roots = []
    for tree in trees:
        weight = bootstrap_weights(len(y), tree, seed)
        drawn = weight > 0
        mine = order[drawn[order]].reshape(len(order), -1)
        roots.append(len(nodes))
        _grow(x, y, weight, mine, min_leaf, nodes)
    feature, cut, below, value = zip(*nodes) if nodes else ((), (), (), ())
    return Trees(np.array(roots, np.int32), np.array(feature, np.int32), np.array(cut, float), np.array(below, np.int32),
                 np.array(value, float))


def _grow(x, y, weight, order, min_leaf: int, nodes: list[list]) -> None:
    nodes.append([LEAF, 0.0, 0, 0.0])
    waiting = [(len(nodes) - 1, order)]
    member = np.zeros(len(y), bool)
    while waiting:
        at, order = waiting.pop()
        rows = order[0]
        nodes[at][3] = float(np.average(y[rows], weights=weight[rows]))
        found = best_split(x, y, weight, order, min_leaf)
        if found is None:
            continue
        feature, size = found
        low, high = order[feature, :size], order[feature, size:]
        cut = (x[low[-1], feature] + x[high[0], feature]) / 2
        if cut >= x[high[0], feature]:  # neighbours so close that their mean rounds up
            cut = x[low[-1], feature]
        nodes[at][:3] = feature, float(cut), len(nodes)
        member[low] = True
        inside = member[order]
        member[low] = False
        nodes.extend([[LEAF, 0.0, 0, 0.0], [LEAF, 0.0, 0, 0.0]])
        waiting.append((len(nodes) - 1, order[~inside].reshape(len(order), -1)))
        waiting.append((len(nodes) - 2, order[inside].reshape(len(order), -1)))


def best_split(x, y, weight, order, min_leaf: int) -> tuple[int, int] | None:
    """(feature, rows below the cut) with the least squared error; the first feature and lowest cut among equals."""
    features, size = order.shape
    if size < 2 * min_leaf or np.ptp(y[order[0]]) == 0 or not features:
        return None
    w = weight[order]
    centred = y - np.average(y[order[0]], weights=w[0])  # keeps the squares of large revenues exact enough
    mass, total = np.cumsum(w, 1)[:, :-1], np.cumsum(w * centred[order], 1)[:, :-1]
    gain = total ** 2 / mass + total ** 2 / (w[0].sum() - mass)  # the centred parts sum to zero
    value = np.take_along_axis(x.T, order, 1)
    allowed = value[:, 1:] > value[:, :-1]
    allowed[:, :min_leaf - 1] = False
    allowed[:, size - min_leaf:] = False
    if not allowed.any():
        return None
    at = int(np.argmax(np.where(allowed, gain, -1.0)))
    return at // (size - 1), at % (size - 1) + 1

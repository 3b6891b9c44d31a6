"""Gradient-boosted trees: fitted on a bounded table of examples on the driver, applied as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    """A leaf with a value, or a split: feature < cut goes left."""

    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int) -> Node:
    best, total = (1e-6, -1, 0.0), g.sum() ** 2 / (h.sum() + 1)
    if depth and len(x) >= 2 * least:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            at = np.flatnonzero(v[1:] != v[:-1])
            at = at[(at + 1 >= least) & (at + 1 <= len(x) - least)]
            if len(at):
                gain = gs[at] ** 2 / (hs[at] + 1) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + 1) - total
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, float(v[at[k]] + v[at[k] + 1]) / 2)
    if best[1] < 0:
        return Node(value=float(g.sum() / (h.sum() + 1)))
    left = x[:, best[1]] < best[2]
    return Node(0.0, best[1], best[2], _grow(x[left], g[left], h[left], depth - 1, least), _grow(x[~left], g[~left], h[~left], depth - 1, least))


def _value(node: Node, x: np.ndarray) -> np.ndarray:
    if node.left is None or node.right is None:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] < node.cut, _value(node.left, x), _value(node.right, x))


@dataclass
class Boosted:
    """Trees of a logistic model, and the calibration of its scores: a * score + b before the sigmoid."""

    start: float
    trees: list[Node]
    rate: float
    a: float = 1.0
    b: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum(_value(t, x) for t in self.trees)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * self.score(x) + self.b)))

    def column(self, features: Column) -> Column:
        """The calibrated probability as an expression of an array of features, which is read and never computed anew."""

        def tree(node: Node) -> Column:
            if node.left is None or node.right is None:
                return F.lit(node.value)
            return F.when(features[node.feature] < node.cut, tree(node.left)).otherwise(tree(node.right))

        total = F.lit(self.start)
        for t in self.trees:
            total = total + F.lit(self.rate) * tree(t)
        return 1 / (1 + F.exp(-(F.lit(self.a) * total + F.lit(self.b))))


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, least: int = 10) -> Boosted:
    """Fit on the rows that are not held out; calibrate (Platt) on the others."""
    a, b = x[~held], y[~held].astype(float)
    p = min(max(b.mean(), 1e-3), 1 - 1e-3)
    model, score = Boosted(float(np.log(p / (1 - p))), [], rate), np.full(len(a), np.log(p / (1 - p)))
    for _ in range(trees):
        q = 1 / (1 + np.exp(-score))
        model.trees.append(_grow(a, b - q, q * (1 - q), depth, least))
        score = score + rate * _value(model.trees[-1], a)
    s, t, w = model.score(x[held]), y[held].astype(float), np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps of a ridged logistic fit
        z = np.stack([s, np.ones(len(s))], 1)
        q = 1 / (1 + np.exp(-z @ w))
        grad = z.T @ (t - q) - 0.1 * (w - [1.0, 0.0])
        w = w + np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + 0.1 * np.eye(2), grad)
    model.a, model.b = float(w[0]), float(w[1])
    return model


def threshold(model: Boosted, x: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest probability from which on held-out rows reach a precision; 1.01 where none does."""
    p, t = model.probability(x), y
    for cut in np.unique(np.floor(p * 1000) / 1000):
        if t[p >= cut].mean() >= precision:
            return float(cut)
    return 1.01

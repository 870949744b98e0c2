"""Gradient-boosted trees for small labelled samples, fitted on the driver and applied as a Spark expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Leaf = float
Tree = tuple  # (feature, bound, tree where value <= bound, tree elsewhere) or a Leaf


def _leaf(rows: list[int], grad: list[float], hess: list[float]) -> float:
    return sum(grad[i] for i in rows) / (sum(hess[i] for i in rows) + 1.0)


def _gain(g: float, h: float) -> float:
    return g * g / (h + 1.0)


def _grow(x: list[list[float]], grad: list[float], hess: list[float], rows: list[int], depth: int, least: int) -> Tree | Leaf:
    if depth == 0 or len(rows) < 2 * least:
        return _leaf(rows, grad, hess)
    total_g, total_h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
    best = (1e-6, None, None)
    for f in range(len(x[0])):
        sums: dict[float, list[float]] = {}
        for i in rows:
            s = sums.setdefault(x[i][f], [0.0, 0.0, 0])
            s[0] += grad[i]
            s[1] += hess[i]
            s[2] += 1
        values, g, h, n = sorted(sums), 0.0, 0.0, 0
        for a, b in zip(values, values[1:], strict=False):
            g, h, n = g + sums[a][0], h + sums[a][1], n + sums[a][2]
            if least <= n <= len(rows) - least:
                gain = _gain(g, h) + _gain(total_g - g, total_h - h) - _gain(total_g, total_h)
                if gain > best[0]:
                    best = (gain, f, (a + b) / 2)
    if best[1] is None:
        return _leaf(rows, grad, hess)
    _, f, bound = best
    return (f, bound, _grow(x, grad, hess, [i for i in rows if x[i][f] <= bound], depth - 1, least), _grow(x, grad, hess, [i for i in rows if x[i][f] > bound], depth - 1, least))


def value_of(tree: Tree | Leaf, row: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


class BoostedTrees:
    """Logistic boosting; ``probability`` is calibrated on held-out rows by a logistic fit of the raw score."""

    def __init__(self, x: list[list[float]], y: list[int], rounds: int = 30, depth: int = 4, rate: float = 0.4, least: int = 5):
        fit = [i for i in range(len(x)) if i % 4]
        held = [i for i in range(len(x)) if i % 4 == 0]
        raw = [0.0] * len(x)
        self.trees, self.rate = [], rate
        for _ in range(rounds):
            p = [1 / (1 + math.exp(-r)) for r in raw]
            tree = _grow(x, [t - q for t, q in zip(y, p, strict=True)], [q * (1 - q) for q in p], fit, depth, least)
            self.trees.append(tree)
            raw = [r + rate * value_of(tree, row) for r, row in zip(raw, x, strict=True)]
        self.slope, self.shift = self._calibrate([raw[i] for i in held], [y[i] for i in held])

    @staticmethod
    def _calibrate(raw: list[float], y: list[int]) -> tuple[float, float]:
        slope, shift = 1.0, 0.0
        for _ in range(300):
            p = [1 / (1 + math.exp(-(slope * r + shift))) for r in raw]
            slope += 0.5 * sum((t - q) * r for t, q, r in zip(y, p, raw, strict=True)) / len(raw)
            shift += 0.5 * sum(t - q for t, q in zip(y, p, strict=True)) / len(raw)
        return slope, shift

    def probability(self, row: list[float]) -> float:
        return 1 / (1 + math.exp(-(self.slope * self.rate * sum(value_of(t, row) for t in self.trees) + self.shift)))

    def column(self, features: list[Column]) -> Column:
        """The calibrated probability as an expression over the feature columns."""

        def of(tree: Tree | Leaf) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(features[tree[0]] <= F.lit(float(tree[1])), of(tree[2])).otherwise(of(tree[3]))

        total = of(self.trees[0])
        for t in self.trees[1:]:
            total = total + of(t)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(total * F.lit(self.slope * self.rate) + F.lit(self.shift))))

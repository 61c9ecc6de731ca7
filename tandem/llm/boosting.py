"""Gradient-boosted trees of depth two: fitted on a small table of whole numbers, applied as a column expression."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Tree:
    """Two levels of ``feature <= bound``; leaves from left to right."""

    splits: list[tuple[int, float]]
    leaves: list[float]

    def values(self, x: np.ndarray) -> np.ndarray:
        left = x[:, self.splits[0][0]] <= self.splits[0][1]
        low = np.where(x[:, self.splits[1][0]] <= self.splits[1][1], self.leaves[0], self.leaves[1])
        high = np.where(x[:, self.splits[2][0]] <= self.splits[2][1], self.leaves[2], self.leaves[3])
        return np.where(left, low, high)

    def column(self, features: list[Column]) -> Column:
        def test(k: int, yes, no) -> Column:
            return F.when(features[self.splits[k][0]] <= F.lit(float(self.splits[k][1])), yes).otherwise(no)

        leaf = [F.lit(float(v)) for v in self.leaves]
        return test(0, test(1, leaf[0], leaf[1]), test(2, leaf[2], leaf[3]))


@dataclass
class Boosted:
    base: float = -20.0
    trees: list[Tree] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.values(x) for t in self.trees), np.zeros(len(x)))

    def margin_column(self, features: list[Column]) -> Column:
        total = F.lit(float(self.base))
        for tree in self.trees:
            total = total + tree.column(features)
        return total

    def column(self, features: list[Column]) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin_column(features)))


def _best_split(x: np.ndarray, gradient: np.ndarray, curve: np.ndarray, ridge: float) -> tuple[int, float]:
    best, found = 0.0, (0, float("inf"))
    g, h = gradient.sum(), curve.sum()
    for f in range(x.shape[1]):
        values, where = np.unique(x[:, f], return_inverse=True)
        gs, hs = np.cumsum(np.bincount(where, gradient)), np.cumsum(np.bincount(where, curve))
        gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
        gain[-1] = 0
        k = int(gain.argmax())
        if gain[k] > best + 1e-9:
            best, found = float(gain[k]), (f, float(values[k] + values[k + 1]) / 2)
    return found


def fit_boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30, rate: float = 0.4, ridge: float = 1.0) -> Boosted:
    """Logistic loss, second-order leaf values. One class alone gives a model without trees."""
    if not len(y):
        return Boosted()
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6))
    model = Boosted(float(np.log(share / (1 - share))))
    if len(set(y)) < 2:
        return model
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = weight * (p - y), weight * p * (1 - p)
        splits, leaves = [_best_split(x, gradient, curve, ridge)], []
        left = x[:, splits[0][0]] <= splits[0][1]
        for side in (left, ~left):
            split = _best_split(x[side], gradient[side], curve[side], ridge) if side.any() else (0, float("inf"))
            splits.append(split)
            low = side & (x[:, split[0]] <= split[1])
            for part in (low, side & ~low):
                leaves.append(-rate * gradient[part].sum() / (curve[part].sum() + ridge))
        tree = Tree([(f, min(b, 1e18)) for f, b in splits], leaves)
        model.trees.append(tree)
        margin = margin + tree.values(x)
    return model


def precision_threshold(score: np.ndarray, y: np.ndarray, weight: np.ndarray, precision: float) -> float:
    """Smallest score from which on at least that share is right; 2, which nothing reaches, if there is none."""
    order = np.argsort(-score, kind="stable")
    s, right, total = score[order], np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    ends = np.append(s[1:] != s[:-1], True) if len(s) else np.zeros(0, bool)
    fine = np.flatnonzero(ends & (right >= precision * total))
    return float(s[fine[-1]]) if len(fine) else 2.0

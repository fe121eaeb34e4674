"""Small decision trees on bounded samples, and their translation into Spark columns."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    """A split ``feature <= threshold`` with its two sides, or a leaf; value is the mean of the target."""

    value: float
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int, least: int, rng: np.random.Generator | None = None, tried: int | None = None) -> Node:
    """A regression tree by squared error; at most 32 thresholds a feature. tried: features drawn for each split."""
    node = Node(float(y.mean()) if len(y) else 0.0)
    if depth == 0 or len(y) < 2 * least or np.ptp(y) == 0:
        return node
    features = np.arange(x.shape[1]) if rng is None or tried is None else rng.choice(x.shape[1], min(tried, x.shape[1]), replace=False)
    best = (1e-12, -1, 0.0)
    for f in features:
        values = np.unique(x[:, f])
        if len(values) < 2:
            continue
        cuts = (values[:-1] + values[1:]) / 2
        cuts = cuts[np.linspace(0, len(cuts) - 1, min(32, len(cuts))).astype(int)]
        order = np.argsort(x[:, f], kind="stable")
        total, n = np.concatenate(([0.0], np.cumsum(y[order]))), np.searchsorted(x[order, f], cuts, "right")
        ok = (n >= least) & (len(y) - n >= least)
        if not ok.any():
            continue
        n, cuts = n[ok], cuts[ok]
        gain = total[n] ** 2 / n + (total[-1] - total[n]) ** 2 / (len(y) - n) - total[-1] ** 2 / len(y)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), int(f), float(cuts[k]))
    if best[1] < 0:
        return node
    node.feature, node.threshold = best[1], best[2]
    side = x[:, node.feature] <= node.threshold
    node.low, node.high = grow(x[side], y[side], depth - 1, least, rng, tried), grow(x[~side], y[~side], depth - 1, least, rng, tried)
    return node


def evaluate(node: Node, x: np.ndarray) -> np.ndarray:
    if node.low is None or node.high is None:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.threshold, evaluate(node.low, x), evaluate(node.high, x))


def column(node: Node, features: list[Column]) -> Column:
    if node.low is None or node.high is None:
        return F.lit(node.value)
    return F.when(features[node.feature] <= node.threshold, column(node.low, features)).otherwise(column(node.high, features))


def forest(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int = 7, least: int = 3) -> list[Node]:
    """A random forest: bootstrapped trees with about the root of the features tried at each split."""
    rng = np.random.default_rng(seed)
    tried = max(2, round(x.shape[1] ** 0.5))
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(grow(x[rows], y[rows].astype(float), depth, least, rng, tried))
    return out


@dataclass(frozen=True)
class Rule:
    """A conjunction of conditions (feature, is at most, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, below, t in self.terms:
            out &= (x[:, f] <= t) if below else (x[:, f] > t)
        return out

    def column(self, features: list[Column]) -> Column:
        terms = [(features[f] <= t) if below else (features[f] > t) for f, below, t in self.terms]
        out = terms[0]
        for t in terms[1:]:
            out = out & t
        return out


def paths(node: Node, so_far: tuple = ()) -> list[Rule]:
    """The rule of each node below the root, with the tightest bound of each feature and side only."""
    if node.low is None or node.high is None:
        return []
    out = []
    for below, child in ((True, node.low), (False, node.high)):
        bounds = {(f, b): t for f, b, t in so_far}
        key = (node.feature, below)
        bounds[key] = node.threshold if key not in bounds else (min if below else max)(bounds[key], node.threshold)
        terms = tuple((f, b, t) for (f, b), t in sorted(bounds.items()))
        out += [Rule(terms), *paths(child, terms)]
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """(intercept, weights) of a logistic regression with an L1 penalty on weights, by accelerated proximal gradient."""
    n, m = a.shape
    bias, w = float(np.log((y.sum() + 1) / (n - y.sum() + 1))), np.zeros(m)
    step = 4 * n / (np.linalg.norm(np.hstack([a, np.ones((n, 1))]), 2) ** 2 + 1e-9)
    v, vb, t = w.copy(), bias, 1.0
    for _ in range(rounds):
        g = sigmoid(a @ v + vb) - y
        nw = v - step * (a.T @ g) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * g.mean()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - bias)
        w, bias, t = nw, nb, nt
    return bias, w


@dataclass
class RuleModel:
    """A sparse sum of rules; its score is a probability."""

    bias: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.bias + sum((w * r.holds(x) for r, w in self.rules), np.zeros(len(x))))

    def column(self, features: list[Column]) -> Column:
        z = F.lit(float(self.bias))
        for r, w in self.rules:
            z = z + F.when(r.column(features), float(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """Boosted trees on random halves of the rows; their paths as rules; lasso weights. With one class only, or no
    row, the model is a constant: the smoothed share of label 1."""
    y = y.astype(float)
    constant = RuleModel(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    if len(y) < 20 or y.min() == y.max():
        return constant
    rng, z, rules = np.random.default_rng(seed), np.full(len(y), constant.bias), {}
    for _ in range(trees):
        rows = rng.random(len(y)) < 0.5
        tree = grow(x[rows], (y - sigmoid(z))[rows], depth, max(3, len(y) // 500))
        z += rate * 4 * evaluate(tree, x)
        for r in paths(tree):
            rules.setdefault(r.holds(x).tobytes(), r)
    found: list[Rule] = [r for r in rules.values() if 0 < r.holds(x).sum() < len(y)]
    if not found:
        return constant
    bias, w = lasso_logistic(np.column_stack([r.holds(x) for r in found]).astype(float), y, penalty)
    return RuleModel(float(bias), [(r, float(v)) for r, v in zip(found, w, strict=True) if abs(v) > 1e-6])



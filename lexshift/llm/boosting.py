"""Gradient-boosted trees: fitted with numpy on a small table, applied as one SQL expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Leaf:
    value: float


@dataclass
class Split:
    feature: int
    at: float
    low: Leaf | Split
    high: Leaf | Split


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, ridge: float, least: int) -> Leaf | Split:
    """A tree for the second-order loss, split where the gain is largest."""
    g, h = grad.sum(), hess.sum()
    best = (1e-6, None)
    if depth and len(x) >= 2 * least:
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, gl, hl = x[order, j], np.cumsum(grad[order]), np.cumsum(hess[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(cut + 1 >= least) & (len(v) - cut - 1 >= least)]
            if len(cut):
                a, b = gl[cut], hl[cut]
                gain = a**2 / (b + ridge) + (g - a) ** 2 / (h - b + ridge) - g**2 / (h + ridge)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, (v[cut[k]] + v[cut[k] + 1]) / 2))
    if best[1] is None:
        return Leaf(float(-g / (h + ridge)))
    j, at = best[1]
    low = x[:, j] <= at
    return Split(j, float(at), _grow(x[low], grad[low], hess[low], depth - 1, ridge, least), _grow(x[~low], grad[~low], hess[~low], depth - 1, ridge, least))


def _apply(tree: Leaf | Split, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.at, _apply(tree.low, x), _apply(tree.high, x))


@dataclass
class Boosted:
    base: float
    rate: float
    trees: list

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum(_apply(t, x) for t in self.trees)

    def sql(self, names: list[str]) -> str:
        """The margin as SQL over the named features."""

        def one(tree) -> str:
            if isinstance(tree, Leaf):
                return f"{tree.value * self.rate:.9e}D"
            return f"IF({names[tree.feature]} <= {tree.at:.6f}D, {one(tree.low)}, {one(tree.high)})"

        return " + ".join([f"{self.base:.9e}D", *map(one, self.trees)])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.4, ridge: float = 1.0, least: int = 8) -> Boosted:
    """Logistic boosting of `rounds` trees."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Boosted(float(np.log(share / (1 - share))), rate, [])
    z = np.full(len(y), model.base)
    for _ in range(rounds):
        p = _sigmoid(z)
        tree = _grow(x, p - y, np.maximum(p * (1 - p), 1e-6), depth, ridge, least)
        model.trees.append(tree)
        z += rate * _apply(tree, x)
    return model


def threshold(margin: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least margin from which on the share of positives is at least `precision`,
    taken half-way to the next lower candidate; infinite if there is none."""
    order = np.argsort(-margin, kind="stable")
    m, hit = margin[order], y[order]
    fine = np.cumsum(hit) / np.arange(1, len(hit) + 1) >= precision
    last = np.r_[m[1:] < m[:-1], True] & fine
    if not last.any():
        return float("inf")
    k = int(np.flatnonzero(last)[-1])
    return float((m[k] + m[k + 1]) / 2) if k + 1 < len(m) else float(m[k])

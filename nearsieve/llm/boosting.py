"""Boosted regression trees for small tables of integer features, exported as SQL."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Sum of trees; a tree is ``(feature, cut, below, above)`` or a leaf's float."""

    names: list[str]
    base: float
    trees: list

    def score(self, x: np.ndarray) -> np.ndarray:
        def walk(tree, rows):
            if isinstance(tree, float):
                return np.full(len(rows), tree)
            f, cut, low, high = tree
            out, below = np.empty(len(rows)), rows[:, f] <= cut
            out[below], out[~below] = walk(low, rows[below]), walk(high, rows[~below])
            return out

        return self.base + sum((walk(t, x) for t in self.trees), np.zeros(len(x)))

    def sql(self, prefix: str = "") -> str:
        def text(tree) -> str:
            if isinstance(tree, float):
                return f"{tree!r}D"
            f, cut, low, high = tree
            return f"(CASE WHEN {prefix}{self.names[f]} <= {cut} THEN {text(low)} ELSE {text(high)} END)"

        return " + ".join([f"{self.base!r}D", *map(text, self.trees)])


def fit(x: np.ndarray, y: np.ndarray, names: list[str], rounds: int = 24, depth: int = 3, rate: float = 0.4, least: float = 2.0) -> Trees:
    """Logistic boosting with Newton leaves; exact search over all cuts, ties to the first feature and cut."""
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    logit, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-logit))
        g, h = y - p, p * (1 - p) + 1e-9

        def grow(rows: np.ndarray, deep: int, g=g, h=h):
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, None, None)
            if deep:
                for f in range(x.shape[1]):
                    v = x[rows, f]
                    order = np.argsort(v, kind="stable")
                    v = v[order]
                    edge = np.flatnonzero(v[1:] > v[:-1])
                    if not len(edge):
                        continue
                    gl, hl = np.cumsum(g[rows][order])[edge], np.cumsum(h[rows][order])[edge]
                    gain = gl**2 / (hl + least) + (gs - gl) ** 2 / (hs - hl + least) - gs**2 / (hs + least)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (float(gain[i]), f, int(v[edge[i]]))
            if best[1] is None:
                return float(rate * gs / (hs + least))
            below = x[rows, best[1]] <= best[2]
            return (best[1], best[2], grow(rows[below], deep - 1), grow(rows[~below], deep - 1))

        tree = grow(np.arange(len(y)), depth)
        trees.append(tree)
        logit = Trees(names, 0.0, [tree]).score(x) + logit
    return Trees(names, base, trees)


def threshold(logits: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest cut at which ``precision`` holds on these labelled logits; infinity if none does."""
    order = np.argsort(-logits, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ends = np.append(np.diff(logits[order]) < 0, True)
    good = np.flatnonzero((right >= precision) & ends)
    return float(logits[order][good[-1]]) if len(good) else float("inf")

"""Gradient-boosted regression trees on binned features, with monotonic constraints, in numpy.

Trees are flattened: node k of a tree has feature, threshold, left, right and
value at position k of five arrays; a leaf points to itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    feature: np.ndarray  # (trees, nodes) int
    threshold: np.ndarray  # (trees, nodes) float: goes left when x <= threshold
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # (trees, nodes) float, leaves only
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x, all trees at once, a step for each level."""
        total = np.full(len(x), self.base)
        if not len(self.feature) or not len(x):
            return total
        at = np.zeros((len(x), len(self.feature)), np.int64)
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        for _ in range(self.depth):
            low = x[row, self.feature[tree, at]] <= self.threshold[tree, at]
            at = np.where(low, self.left[tree, at], self.right[tree, at])
        return total + self.value[tree, at].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def cuts_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Ascending split points of each feature: midpoints between the values at its quantiles."""
    out = []
    for f in range(x.shape[1]):
        v = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1), method="nearest")) if len(x) else np.zeros(0)
        out.append((v[1:] + v[:-1]) / 2)
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 10, monotone: dict[int, int] | None = None, rows: float = 1.0, seed: int = 0) -> Forest:
    """Boost the logistic loss.  monotone: feature -> +1 (score may only rise with it) or -1.

    A split that breaks a constraint is refused, and the midpoint of its two
    values bounds everything below on either side.  Without rows, or with one
    class only, the forest is its base value.
    """
    monotone = monotone or {}
    n = len(y)
    p0 = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base, size = float(np.log(p0 / (1 - p0))), 2 ** (depth + 1) - 1
    empty = np.zeros((0, size))
    if n == 0 or y.min() == y.max():
        return Forest(empty.astype(int), empty, empty.astype(int), empty.astype(int), empty, base, depth)
    cuts = cuts_of(x, bins)
    code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    raw, made, rng = np.full(n, base), [], np.random.default_rng(seed)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        use = rng.random(n) < rows if rows < 1 else slice(None)
        tree = _grow(code[use], (p - y)[use], (p * (1 - p))[use], cuts, depth, ridge, least, rate, monotone)
        made.append(tree)
        one = Forest(*(a[None] for a in tree), 0.0, depth)
        raw = raw + one.raw(x)
    return Forest(*(np.stack([t[k] for t in made]) for k in range(5)), base, depth)


def _grow(code, g, h, cuts, depth, ridge, least, rate, monotone):
    size = 2 ** (depth + 1) - 1
    feature, threshold, value = np.zeros(size, int), np.full(size, np.inf), np.zeros(size)
    left = np.arange(size)
    right = np.arange(size)
    low, high = np.full(size, -np.inf), np.full(size, np.inf)
    rows_of = {0: np.arange(len(g))}

    def best_value(sg, sh, k):
        return np.clip(-sg / (sh + ridge), low[k], high[k])

    for k in range(size):
        rows = rows_of.pop(k, None)
        if rows is None:
            continue
        sg, sh = g[rows].sum(), h[rows].sum()
        value[k] = best_value(sg, sh, k)
        if k >= size // 2 or len(rows) < 2 * least:
            continue
        best, pick = 1e-6, None
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = code[rows, f]
            n_l = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            g_l = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
            h_l = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
            v_l, v_r = best_value(g_l, h_l, k), best_value(sg - g_l, sh - h_l, k)
            loss = lambda v, a, q: a * v + 0.5 * (q + ridge) * v * v
            gain = loss(value[k], sg, sh) - loss(v_l, g_l, h_l) - loss(v_r, sg - g_l, sh - h_l)
            ok = (n_l >= least) & (len(rows) - n_l >= least) & (monotone.get(f, 0) * (v_r - v_l) >= 0)
            gain = np.where(ok, gain, -np.inf)
            j = int(gain.argmax())
            if gain[j] > best:
                best, pick = gain[j], (f, j, float(v_l[j]), float(v_r[j]))
        if pick is None:
            continue
        f, j, v_l, v_r = pick
        feature[k], threshold[k], left[k], right[k] = f, cuts[f][j], 2 * k + 1, 2 * k + 2
        goes = code[rows, f] <= j
        rows_of[2 * k + 1], rows_of[2 * k + 2] = rows[goes], rows[~goes]
        low[[2 * k + 1, 2 * k + 2]], high[[2 * k + 1, 2 * k + 2]] = low[k], high[k]
        if f in monotone:
            mid = (v_l + v_r) / 2
            upper, lower = (2 * k + 2, 2 * k + 1) if monotone[f] > 0 else (2 * k + 1, 2 * k + 2)
            low[upper], high[lower] = max(low[upper], mid), min(high[lower], mid)
    return feature, threshold, left, right, value * rate

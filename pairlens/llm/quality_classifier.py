"""Quality classifier: a sparse rule ensemble over document statistics.

Boosted trees are grown on a bounded sample of labelled documents; every path
from a root to an inner node or leaf is a conjunctive rule.  A lasso logistic
regression keeps few of them, and those are compiled into one Spark column
expression that scores every document.

Defined cases: null and empty texts have zero statistics and are scored like
any text; a null doc_id is never held out; repeated rows are scored each; an
empty or one-class label table gives every document the same prior score (0.5
without labels); extra columns pass `classify` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm import textstats, trees
from pairlens.llm.common import bucket, label_sample

#: Labelled rows to learn from, at most (about).
SAMPLE = 16_000
HELD = (5, 0)
THRESHOLD = 0.3


@dataclass(frozen=True)
class Rule:
    """Conjunction: each term is (feature, at_most, bound); at_most False means greater than."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for f, at_most, v in self.terms:
            ok &= x[:, f] <= v if at_most else x[:, f] > v
        return ok

    def column(self, stats: Column, names: list[str]) -> Column:
        parts = [stats[names[f]] <= F.lit(v) if at_most else stats[names[f]] > F.lit(v) for f, at_most, v in self.terms]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out


def rules_of(forest: trees.Forest) -> list[Rule]:
    """Every distinct path of every tree, simplified to one bound a feature and direction."""
    found: dict[tuple, None] = {}
    for t in range(len(forest.feature)):
        stack = [(0, ())]
        while stack:
            k, terms = stack.pop()
            if terms:
                tight: dict[tuple[int, bool], float] = {}
                for f, at_most, v in terms:
                    old = tight.get((f, at_most), v)
                    tight[f, at_most] = min(old, v) if at_most else max(old, v)
                found[tuple(sorted((f, a, v) for (f, a), v in tight.items()))] = None
            if forest.left[t, k] != k:
                f, v = int(forest.feature[t, k]), float(forest.threshold[t, k])
                stack += [(int(forest.left[t, k]), (*terms, (f, True, v))), (int(forest.right[t, k]), (*terms, (f, False, v)))]
    return [Rule(x) for x in found]


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise mean log loss + penalty * |w|, by accelerated proximal gradient."""
    n, k = z.shape
    mean = z.mean(0)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-4))
    s = (z - mean) / scale
    v = np.random.default_rng(0).normal(size=k)
    for _ in range(20):
        v = s.T @ (s @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.26 * (np.linalg.norm(s @ v) ** 2 / n + 1))
    w, b, u, c, t = np.zeros(k), float(np.log(y.mean() / (1 - y.mean()))), np.zeros(k), 0.0, 1.0
    c = b
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(s @ u + c, -40, 40))) - y
        new, b_new = u - step * (s.T @ r) / n, c - step * r.mean()
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = new + (t - 1) / t_new * (new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = new, b_new, t_new
    w = w / scale
    return float(b - w @ mean), w


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[Rule]
    weights: list[float]
    names: list[str]

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.intercept)
        for r, w in zip(self.rules, self.weights, strict=True):
            raw += w * r.holds(x)
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))

    def column(self, stats: Column) -> Column:
        """The score as a column over a struct of statistics."""
        raw = F.lit(float(self.intercept))
        for r, w in zip(self.rules, self.weights, strict=True):
            raw = raw + F.when(r.column(stats, self.names), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), raw))))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.002, names: list[str] | None = None) -> RuleEnsemble:
    names = names or textstats.RATIOS
    if len(y) == 0 or y.min() == y.max():
        p = float(np.clip(y.mean(), 0.02, 0.98)) if len(y) else 0.5
        return RuleEnsemble(float(np.log(p / (1 - p))), [], [], names)
    forest = trees.fit(x, y, trees=25, depth=3, rate=0.3, rows=0.6)
    rules = [r for r in rules_of(forest) if 5 <= r.holds(x).sum() <= len(x) - 5]
    if not rules:
        return RuleEnsemble(forest.base, [], [], names)
    z = np.stack([r.holds(x) for r in rules], 1).astype(np.float64)
    _, first = np.unique(z, axis=1, return_index=True)
    keep = np.sort(first)
    b, w = lasso_logistic(z[:, keep], y.astype(float), penalty)
    on = [i for i in range(len(keep)) if abs(w[i]) > 1e-4]
    return RuleEnsemble(b, [rules[keep[i]] for i in on], [float(w[i]) for i in on], names)


def labelled_matrix(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the sampled documents, on the driver; `bound` limits both."""
    sample = label_sample(labels, label, modulus, held, bound)
    met = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    got = textstats.with_stats(met).select("doc_id", "y", *[F.col("__stats")[k].alias(k) for k in textstats.RATIOS]).toPandas()
    got = got.sort_values(["doc_id", *textstats.RATIOS], kind="stable").drop_duplicates("doc_id")
    return got[textstats.RATIOS].to_numpy(float), got["y"].to_numpy(float)


def classify(docs: DataFrame, model: RuleEnsemble, out: str = "__quality") -> DataFrame:
    """docs with a column `out`: the probability that the text is of good quality."""
    stats = out + "_stats"
    while stats in docs.columns:
        stats += "_"
    return textstats.with_stats(docs, out=stats).withColumn(out, model.column(F.col(stats))).drop(stats)


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, held: tuple[int, int] = HELD) -> RuleEnsemble:
    return fit(*labelled_matrix(docs, labels, "quality", *held, bound))


def score_documents(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = classify(docs.select("doc_id", "text"), train(docs, labels, bound))
    return scored.select(
        "doc_id", (bucket("doc_id", HELD[0]) == HELD[1]).alias("held_out"),
        F.col("__quality").alias("score"), (F.col("__quality") >= threshold).cast("int").alias("predicted"),
    )

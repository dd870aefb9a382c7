"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme values.

Tokens are lower-cased runs of letters.  In a bounded sample of labelled documents
every token, and every prefix of four to six letters, has a share of toxic ones
among the documents that hold it.  A Dirichlet prior shrinks the share towards
that of the next shorter prefix, and in the end of all documents; the log-odds of
the share against all documents, less a drift, is the score of the token.
So each token has a score of its own, tokens never seen that of their longest
known prefix, and clean words count against a passage.  Features in fewer than
LEAST_DOCS documents, or that change their prefix's score by less than LEAST_STEP,
score as that prefix.

A linear scan finds all maximal segments of a document.  In n tokens of clean text
the expected number of segments with a score of S or more is K n exp(-lambda S);
both constants are the most likely ones for the best segments of all clean sample
documents (those without any count as censored).  A document's score is a logistic
function of the summed -log10 of that number over its significant segments.  If
the sample is large enough, a part that the shares have not seen calibrates.

Defined cases: null and empty texts have no segment and get the lowest score; a
null doc_id is never held out; repeated rows are scored each; without labels of
both classes all scores are equal to the base rate (0 without labels); extra
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import bucket, label_sample, stored

#: Labelled rows to learn from, at most (about).
SAMPLE = 24_000
HELD = (4, 2)
THRESHOLD = 0.3
#: Weight of the prior in documents, what each token's score is lowered by, and the two limits of a feature.
#: Chosen by the log loss of three-fold cross-validation over training rows alone; no held-out row took part.
PRIOR, DRIFT, LEAST_DOCS, LEAST_STEP = 20.0, 1.5, 2, 0.05
PREFIXES = (4, 5, 6)
#: Segments expected less often than this in clean text of the document's length are significant.
SIGNIFICANT = 0.05
#: One of so many documents calibrates if it gives this many of either class; else all do both.
CALIBRATE, ENOUGH = 4, 100
TOKEN = re.compile(r"[^\W\d_]+")


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def features_of(token: str) -> list[str]:
    """The token and its prefixes, which are marked by an asterisk; most specific first."""
    return [token, *[f"{token[:k]}*" for k in reversed(PREFIXES) if len(token) >= k]]


def log_odds(counts: dict[str, tuple[int, int]], n_clean: int, n_toxic: int, prior: float = PRIOR, step: float = LEAST_STEP) -> dict[str, float]:
    """Log-odds of each feature against all documents; counts: (clean, toxic) documents that hold it."""
    root = n_toxic / (n_toxic + n_clean)
    share, out = {"": root}, {"": 0.0}
    logit = lambda p: float(np.log(p / (1 - p)))
    # prefixes before tokens, short ones first, so that what a feature falls back to is known
    for f in sorted(counts, key=lambda f: (f[-1] != "*", len(f), f)):
        above = next((g for g in _above(f) if g in share), "")
        clean, toxic = counts[f]
        share[f] = (toxic + prior * share[above]) / (toxic + clean + prior)
        out[f] = logit(share[f]) - logit(root)
        if abs(out[f] - out[above]) < step:
            del share[f], out[f]
    del out[""]
    return out


def _above(feature: str) -> list[str]:
    """What a feature falls back to, nearest first."""
    if feature[-1:] == "*":
        return [f"{feature[:k]}*" for k in reversed(PREFIXES) if k < len(feature) - 1]
    return features_of(feature)[1:]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), in linear time.

    Each candidate carries the cumulative score before and behind it; a new one is
    joined to the nearest candidate with a smaller score before it unless that one
    ends higher.
    """
    out: list[tuple[int, int, float, float]] = []
    lower: list[int] = []  # for each candidate, the nearest earlier one that starts lower
    total = np.concatenate([[0.0], np.cumsum(scores)])
    places = np.flatnonzero(scores > 0)
    for p, before, behind in zip(places.tolist(), total[places].tolist(), total[places + 1].tolist(), strict=True):
        first = p
        k = len(out) - 1
        while True:
            while k >= 0 and out[k][2] >= before:
                k = lower[k]
            if k < 0 or out[k][3] >= behind:
                break
            first, before = out[k][0], out[k][2]
            del out[k:], lower[k:]
            k = len(out) - 1
        out.append((first, p, before, behind))
        lower.append(k)
    return [(a, b, r - q) for a, b, q, r in out]


@dataclass
class Model:
    odds: dict[str, float]
    decay: float = 1.0  # lambda
    scale: float = 1.0  # K
    intercept: float = 0.0
    slope: float = 1.0
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def score(self, token: str) -> float:
        if (w := self.known.get(token)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            w = self.known[token] = next((self.odds[f] for f in features_of(token) if f in self.odds), 0.0) - DRIFT
        return w

    def scores(self, text: str | None) -> np.ndarray:
        return np.array([self.score(x) for x in tokens_of(text)], float)

    def best(self, text: str | None) -> tuple[int, float]:
        """Tokens of the text and the score of its best segment (0 without one)."""
        s = self.scores(text)
        return len(s), max((x for *_, x in segments(s)), default=0.0)

    def scored(self, texts: list[str | None]) -> tuple[list[list[tuple[int, int, float, float]]], np.ndarray]:
        """Significant segments of each text as (first, last, score, expected), and each text's evidence."""
        found, evidence = [], np.zeros(len(texts))
        for k, t in enumerate(texts):
            s = self.scores(t)
            # what a segment must score to be significant
            least = np.log(self.scale * len(s) / SIGNIFICANT) / self.decay if len(s) else 0.0
            kept = []
            if s[s > 0].sum() >= least:
                for a, b, x in segments(s):
                    expected = self.scale * len(s) * np.exp(-self.decay * x)
                    if expected <= SIGNIFICANT:
                        kept.append((a, b, float(x), float(expected)))
            evidence[k] = sum(-np.log10(max(x[3], 1e-300)) for x in kept)
            found.append(kept)
        return found, evidence

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * np.log1p(evidence), -40, 40)))


def extreme_values(size: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """lambda and K that make the best segments (0: none) of texts of these sizes most likely.

    The best score of n tokens is below S with the probability exp(-K n exp(-lambda S)).
    """
    some = best > 0
    if some.sum() < 2:
        return 1.0, float((some.sum() + 1) / max(1, size.sum()))

    def at(decay: float) -> tuple[float, float]:
        mass = float((size * np.exp(-decay * best)).sum())
        scale = some.sum() / mass
        return float(some.sum() * (np.log(decay) + np.log(scale)) - decay * best[some].sum() - scale * mass), scale

    low, high, ratio = np.log(0.01), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(80):  # golden section
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (a, high) if at(np.exp(a))[0] < at(np.exp(b))[0] else (low, b)
    decay = float(np.exp((low + high) / 2))
    return decay, float(at(decay)[1])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> tuple[float, float]:
    """Intercept and slope (not below 0) by Newton steps with a small ridge on the slope."""
    rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    a, s = float(np.log(rate / (1 - rate))), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a + s * x, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([(p - y).sum(), ((p - y) * x).sum() + 0.01 * s])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, s = a - step[0], s - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(max(s, 0.0))


def _counts(sample: DataFrame) -> DataFrame:
    """(feature, d0, d1): how many documents of each class hold a feature; the empty feature counts documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                found: tuple[Counter, Counter] = (Counter(), Counter())
                for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found[y].update({f for x in set(tokens_of(t)) for f in features_of(x)})
                    found[y][""] += 1
                names = list(found[0] | found[1])
                yield pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()), "d0": pa.array([found[0][f] for f in names], pa.int64()), "d1": pa.array([found[1][f] for f in names], pa.int64())})

    return sample.select("text", "y").mapInArrow(run, "feature string, d0 long, d1 long").groupBy("feature").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, held: tuple[int, int] = HELD) -> Model:
    sample = label_sample(labels, "toxic", *held, bound)
    parts = docs.sparkSession.sparkContext.defaultParallelism
    own = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), F.lit(CALIBRATE)) == 0
    met = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(sample), "doc_id").select("text", "y", own.alias("late")).repartition(parts)
    met = stored(met, "sample")
    many = {(r.late, r.y): r["count"] for r in met.groupBy("late", "y").count().collect()}
    if not all(sum(n for (_, y), n in many.items() if y == k) for k in (0, 1)):
        n = sum(many.values())
        p = np.clip(sum(k for (_, y), k in many.items() if y) / n, 0.0, 1.0) if n else 0.0
        return Model({}, intercept=float(np.log(max(p, 1e-6) / max(1 - p, 1e-6))), slope=0.0)
    apart = all(many.get((late, y), 0) >= ENOUGH for late in (True, False) for y in (0, 1))
    rows = _counts(met.where("not late") if apart else met).where(F.col("d0") + F.col("d1") >= LEAST_DOCS).collect()
    counts = {r.feature: (r.d0, r.d1) for r in rows}
    n0, n1 = counts.pop("", None) or (max(1, sum(n for (_, y), n in many.items() if not y)), sum(n for (_, y), n in many.items() if y))
    return calibrated(met.where("late") if apart else met, log_odds(counts, n0, n1))


def calibrated(sample: DataFrame, odds: dict[str, float]) -> Model:
    """The model of these log-odds: the best segments of clean texts and the evidence of all set its constants."""
    model = Model(odds)
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def heights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.best(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"size": pa.array([n for n, _ in found], pa.int64()), "best": pa.array([s for _, s in found], pa.float64())})

    high = sample.where("y = 0").select("text").mapInArrow(heights, "size long, best double").toPandas()
    high = high[high["size"] > 0].sort_values(["size", "best"])
    model.decay, model.scale = extreme_values(high["size"].to_numpy(float), high["best"].to_numpy(float))
    fitted = sample.sparkSession.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"y": b.column(1), "x": pa.array(fitted.value.scored(b.column(0).to_pylist())[1])})

    both = sample.select("text", "y").mapInArrow(evidence, "y int, x double").toPandas().sort_values(["y", "x"])
    model.intercept, model.slope = logistic(np.log1p(both["x"].to_numpy(float)), both["y"].to_numpy(float))
    return model


SCORED = "doc_id {kind}, score double, segments array<struct<first:int,last:int,score:double,expected:double>>"


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the significant segments (token places, inclusive) of every row of docs (doc_id, text)."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                found, evidence = model.scored(part.column(1).to_pylist())
                rows = [[{"first": a, "last": z, "score": s, "expected": e} for a, z, s, e in x] for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.probability(evidence)), pa.array(rows, kind)], names=["doc_id", "score", "segments"])

    own = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, SCORED.format(kind=own))


def score_documents(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and n_segments for every document."""
    return passages(docs, train(docs, labels, bound)).select(
        "doc_id", (bucket("doc_id", HELD[0]) == HELD[1]).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("segments").alias("n_segments"),
    )

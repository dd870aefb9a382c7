"""Quality rules: boosted trees over document statistics, scored from flat node arrays.

The base rules fail short texts and texts made of repeated words.  For the rest
the forest decides: it is fitted on a bounded sample of labelled documents, may
only lose score as symbols, marks, repeats and duplicate lines grow, and is
evaluated for whole batches, a numpy step for each level of all trees.

Defined cases: a null text has no words, so it fails the base rules; repeated
rows are judged each; without labels, or with one class, every text that meets
the base rules is kept; extra columns pass `judge` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm import textstats, trees
from pairlens.llm.quality_classifier import labelled_matrix

#: Labelled rows to learn from, at most (about).
SAMPLE = 16_000
HELD = (5, 0)
#: Kept from this probability of good quality on.
THRESHOLD = 0.3
LEAST_WORDS = 50
#: A text fails when more than this per cent of its words are repeated.
MOST_REPEAT = 50
#: Statistics whose growth may only lower the score.
FALLING = ["symbol_ratio", "pipe_ratio", "mark_ratio", "dup_line_ratio", "repeat_ratio", "adjacent_ratio"]

VERDICT = T.StructType(
    [T.StructField(k, T.LongType()) for k in textstats.COUNTS]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("tree_score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
)


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, held: tuple[int, int] = HELD) -> trees.Forest:
    x, y = labelled_matrix(docs, labels, "quality", *held, bound)
    falling = {textstats.RATIOS.index(k): -1 for k in FALLING}
    if len(y) == 0 or y.min() == y.max():
        y = np.ones(len(y))
    forest = trees.fit(x, y, trees=40, depth=3, monotone=falling)
    if len(y) == 0:
        forest.base = 10.0
    return forest


def judge(docs: DataFrame, forest: trees.Forest, text: str = "text", threshold: float = THRESHOLD, out: str = "__verdict") -> DataFrame:
    """docs with a struct column `out` of VERDICT; all columns pass through."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                counts, ratios = textstats.stats_of(part.column(at).to_pylist())
                n, repeat = counts[:, 0], counts[:, textstats.COUNTS.index("n_repeat_words")]
                failed = (n < LEAST_WORDS) | (100 * repeat > MOST_REPEAT * n)
                score = forest.probability(ratios)
                cols = [pa.array(counts[:, k]) for k in range(counts.shape[1])] + [pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
                verdict = pa.StructArray.from_arrays(cols, names=VERDICT.names)
                yield pa.RecordBatch.from_arrays([*part.columns, verdict], names=[*part.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, VERDICT)]))


def judge_documents(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, the five counts, base_failed, tree_score and kept for every document."""
    return judge(docs.select("doc_id", "text"), train(docs, labels, bound)).select("doc_id", *[F.col("__verdict")[k].alias(k) for k in VERDICT.names])

"""Statistics of whole texts, one Arrow pass: counts of words, characters, lines and repeats."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SYMBOLS = b"#*$%&|<>"
#: Counts, in the order of the struct that with_stats adds.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Ratios derived from them and from the byte histogram: the inputs of the models.
RATIOS = [
    "log_words", "mean_word", "symbol_ratio", "pipe_ratio", "mark_ratio", "upper_ratio", "digit_ratio",
    "punct_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "adjacent_ratio", "line_words", "alpha_ratio",
]
_PUNCT = np.array([c for c in range(33, 127) if not chr(c).isalnum()])


def counts_of(text: str | None) -> tuple[list[int], list[float]]:
    """COUNTS and RATIOS of one text; a null text counts as empty.

    Words are runs without the six ASCII white-space characters, which is what
    bytes.split() cuts at.  A word is repeated when it lies in a three-word window
    that the text holds at least twice.
    """
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = len(raw) - int(hist[128:192].sum())
    blanks = int(hist[9:14].sum() + hist[32])
    chars = points - blanks
    symbols = int(hist[list(SYMBOLS)].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 3:
        tri = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(tri)) < len(tri):
            times = Counter(tri)
            hit = np.fromiter((times[t] > 1 for t in tri), bool, len(tri))
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : k + len(tri)] |= hit
            repeat = int(covered.sum())
    w, c = max(1, n), max(1, chars)
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    wide = points - int(hist[:128].sum())
    ratios = [
        float(np.log1p(n)), chars / w, symbols / c, int(hist[124]) / w, int(hist[33]) / w, upper / max(1, upper + lower),
        int(hist[48:58].sum()) / c, int(hist[_PUNCT].sum()) / c, dup / max(1, len(lines)), repeat / w,
        len(set(words)) / w, sum(map(eq, words, words[1:])) / w, float(np.log1p(n / max(1, len(lines)))), (upper + lower + wide) / c,
    ]
    return [n, chars, symbols, dup, repeat], ratios


FIELDS = T.StructType([T.StructField(k, T.LongType()) for k in COUNTS] + [T.StructField(k, T.DoubleType()) for k in RATIOS])
_ARROW = pa.struct([(k, pa.int64()) for k in COUNTS] + [(k, pa.float64()) for k in RATIOS])


def stats_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices, a row for each text: COUNTS (int64) and RATIOS (float64)."""
    found = [counts_of(t) for t in texts]
    return (
        np.array([c for c, _ in found], np.int64).reshape(len(found), len(COUNTS)),
        np.array([r for _, r in found], np.float64).reshape(len(found), len(RATIOS)),
    )


def with_stats(df: DataFrame, text: str = "text", out: str = "__stats") -> DataFrame:
    """df with a struct column `out` of all statistics; the other columns pass through untouched."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                counts, ratios = stats_of(part.column(at).to_pylist())
                cols = [pa.array(counts[:, k]) for k in range(len(COUNTS))] + [pa.array(ratios[:, k]) for k in range(len(RATIOS))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(cols, fields=list(_ARROW))], names=[*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, FIELDS)]))

"""Resampling by hash-derived draws: the same result on every engine and for every partitioning.

A draw is a chain of products modulo the prime 2**31 - 1, which any engine with
64-bit integers repeats exactly and cheaply.  Rows are resampled by Poisson weights:
in each draw a row counts as often as a Poisson variable of mean one says, from its
own key alone.  So nothing but partial sums by draw is shuffled, and no row is
looked up or numbered.  Few large clusters are resampled with a fixed number of
slots instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

P = 2**31 - 1
#: Draws of an interval, and groups whose sums a task holds.
DRAWS, GROUPS = 10_000, 64
#: Where the Poisson distribution of mean one passes 0, 1, 2, ... in units of 1 / P.
STEPS = [int(P * sum(exp(-1) / factorial(j) for j in range(k + 1))) for k in range(10)]


def scattered(df: DataFrame, draw: str, key: str, seed: int, out: str) -> DataFrame:
    """df with a number below P from a draw, a key (an integer) and a seed; column by column, so that no step is repeated."""
    k, h, d = F.col("__k"), F.col("__h"), F.col(draw)
    df = df.withColumn("__k", F.pmod(F.col(key).cast("long"), F.lit(P)))
    df = df.withColumn("__h", F.pmod(k * 48271 + d * 16807 + seed, F.lit(P)))
    df = df.withColumn("__h", F.pmod(h * h + d * 40692 + seed, F.lit(P)))
    df = df.withColumn("__h", F.pmod(h * h + k, F.lit(P)))
    return df.withColumn(out, F.pmod(h * 48271 + 11, F.lit(P))).drop("__k", "__h")


def scattered_sql(source: str, draw: str, key: str, seed: int) -> str:
    """Table expression: source with the number x of `scattered`."""
    steps = [f"(({key})::bigint % {P} + {P}) % {P} as key0", f"(key0 * 48271 + {draw} * 16807 + {seed}) % {P} as h1", f"(h1 * h1 + {draw} * 40692 + {seed}) % {P} as h2", f"(h2 * h2 + key0) % {P} as h3", f"(h3 * 48271 + 11) % {P} as x"]
    for step in steps:
        source = f"(select *, {step} from {source})"
    return source


def poisson(number: Column) -> Column:
    """How often a row counts, from its number below P."""
    return sum(((number >= x).cast("int") for x in STEPS[1:]), (number >= STEPS[0]).cast("int"))


def means_sql(source: str, by: str, key: str, value: str, seed: int, draws: int = DRAWS) -> str:
    """Query of (by, draw, m) as `bootstrap_means` gives them for a table expression."""
    weight, name = " + ".join(f"(x >= {x})::int" for x in STEPS), by.split(" as ")[-1]
    each = scattered_sql(f"(select {by}, {key} as key, {value} as v, draw from {source}, (select unnest(range({draws})) as draw))", "draw", "key", seed)
    return f"select {name}, draw, sum(v * w)::double / sum(w) as m from (select {name}, draw, v, {weight} as w from {each}) group by all having sum(w) > 0"


def drawn(df: DataFrame, draws: int) -> DataFrame:
    return df.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))


def numbers(draw: np.ndarray, key: np.ndarray, seed: int) -> np.ndarray:
    """`scattered` for all draws (rows) and keys (columns)."""
    k, d = (key % P)[None, :], draw[:, None]
    h = (k * 48271 + d * 16807 + seed) % P
    h = (h * h + d * 40692 + seed) % P
    h = (h * h + k) % P
    return (h * 48271 + 11) % P


def bootstrap_means(df: DataFrame, by: list[str], key: str, value: str, draws: int, seed: int) -> DataFrame:
    """(by, draw, m): mean of value over a resample of the group's rows, for each draw; a draw without rows is left out.

    key: an integer that tells rows apart; equal keys are drawn together, so
    groups with the same items are resampled alike.  Rows without a value do not
    count.  Weights are made for blocks of draws and rows at once; a task hands on
    sums by group and draw, of at most GROUPS groups at a time.
    """
    rows = df.select(*by, F.col(key).cast("long").alias("__key"), F.col(value).cast("double").alias("__v")).where("__v is not null and __key is not null")
    kinds = [f for f in rows.schema.fields if f.name in by]
    out = T.StructType([*kinds, T.StructField("draw", T.LongType()), T.StructField("s", T.DoubleType()), T.StructField("n", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def sums() -> pa.RecordBatch:
            cols = [pa.array([g[k] for g in held for _ in range(draws)], kind[k]) for k in range(len(by))]
            s, n = (np.concatenate([x[k] for x in held.values()]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([*cols, pa.array(np.tile(np.arange(draws), len(held))), pa.array(s), pa.array(n)], names=out.names)

        kind: list[pa.DataType] = []
        for b in batches:
            kind = [b.schema.field(k).type for k in range(len(by))]
            for start in range(0, b.num_rows, 4096):
                part = b.slice(start, 4096)
                keys, v = part.column(len(by)).to_numpy(), part.column(len(by) + 1).to_numpy()
                places: dict[tuple, list[int]] = {}
                for k, g in enumerate(zip(*(part.column(c).to_pylist() for c in range(len(by))), strict=True)):
                    places.setdefault(g, []).append(k)
                if held and len(held) + len(places) > GROUPS:
                    yield sums()
                    held = {}
                for g in places:
                    held.setdefault(g, np.zeros((2, draws)))
                same, back = np.unique(keys, return_inverse=True)
                table = np.stack([v, np.ones(len(v))], 1)
                for first in range(0, draws, 512):
                    x = numbers(np.arange(first, min(draws, first + 512)), same, seed)
                    w = np.zeros(x.shape, np.uint8)
                    for step in STEPS:
                        w += x >= step
                    w = w.astype(float)
                    for g, own in places.items():
                        held[g][:, first : first + 512] += (w[:, back[own]] @ table[own]).T
        if held:
            yield sums()

    total = rows.mapInArrow(run, out).groupBy(*by, "draw").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return total.where("n > 0").select(*by, "draw", (F.col("s") / F.col("n")).alias("m"))


def intervals(means: DataFrame, by: list[str], level: float = 0.95) -> DataFrame:
    """Percentile interval of resampled means with linear interpolation."""
    tail = (1 - level) / 2
    return means.groupBy(*by).agg(F.count("*").alias("draws"), F.round(F.percentile("m", tail), 6).alias("low"), F.round(F.percentile("m", 1 - tail), 6).alias("high"), F.round(F.avg("m"), 6).alias("mean"))


def paired_difference(df: DataFrame, by: list[str], item: str, a: str, b: str, draws: int, seed: int) -> DataFrame:
    """Bootstrap interval of the mean of b - a over items."""
    d = df.groupBy(*by, item).agg(F.avg(F.col(b).cast("double") - F.col(a).cast("double")).alias("d"))
    return intervals(bootstrap_means(d, by, item, "d", draws, seed), by)


def matched_difference(df: DataFrame, item: str, method: str, value: str, left: str, right: str, draws: int, seed: int) -> DataFrame:
    """Right minus left over items that both methods have, by means of an item's ratings, with a bootstrap interval over items."""
    mean = lambda m: F.avg(F.when(F.col(method) == m, F.col(value).cast("double")))
    d = df.groupBy(item).agg((mean(right) - mean(left)).alias("d")).where("d is not null").withColumn("__all", F.lit(1))
    whole = d.groupBy("__all").agg(F.count("*").alias("items"), F.round(F.avg("d"), 6).alias("difference"))
    ends = intervals(bootstrap_means(d, ["__all"], item, "d", draws, seed), ["__all"])
    return whole.join(ends, "__all").select(F.lit(left).alias("left_method"), F.lit(right).alias("right_method"), "items", "difference", "draws", "low", "high")


def cluster_means(df: DataFrame, by: list[str], cluster: str, value: str, draws: int, seed: int) -> DataFrame:
    """Bootstrap interval of the mean of all rows when whole clusters are drawn, as many as there are.

    The rows of a cluster are summed first; clusters are few (they are numbered in one task a group).
    """
    per = df.groupBy(*by, cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(value).alias("k"))
    w = Window.partitionBy(*by)
    rows = per.withColumn("__pos", F.row_number().over(w.orderBy(cluster)) - 1).withColumn("__n", F.count("*").over(w))
    slots = drawn(rows.select(*by, "__pos", "__n"), draws)
    picks = scattered(slots, "draw", "__pos", seed, "__x").select(*by, "draw", (F.col("__x") % F.col("__n")).alias("__pos"))
    met = picks.join(rows.select(*by, "__pos", "s", "k"), [*by, "__pos"])
    return intervals(met.groupBy(*by, "draw").agg((F.sum("s") / F.sum("k")).alias("m")), by)

"""Stratified bootstrap of fixed size: in every draw the counts of a stratum's rows add up to exactly its size.

Rows with equal values are exchangeable, so a draw needs only how many of the
resampled rows fall on each distinct value.  A binary tree over the values splits
the stratum's n rows: a node hands a binomial part of its rows, by the share of
rows below its left child, to the left, and the rest to the right.  Down to the
values that is the multinomial of drawing n rows with replacement; no row is
numbered, looked up or weighted, and paired outcomes cost the same for a thousand
items and for a billion.

The upper levels of the tree are ranges of the values' hashes, so that a task holds
a block of about BLOCK values at most; it walks its own path from the root, whose
draws depend on the node alone.  Binomial numbers come from a hash of draw and node
by inversion of the distribution function, so any engine draws the same.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.operators.resample import DRAWS, P, numbers, scattered_sql

#: Distinct values of a stratum that a task holds, about.
BLOCK = 4096


def binomial(n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """Binomial numbers of n trials each: the smallest k whose distribution function exceeds u.

    Every distinct n has its masses once, within eleven standard deviations of the
    mean (beyond them lies less than 1e-27), by ratios from the mode.
    """
    out = np.zeros(len(n), np.int64)
    if p >= 1:
        return n.astype(np.int64)
    if p <= 0:
        return out
    for size in np.unique(n).tolist():
        own = n == size
        reach = 11 * math.sqrt(size * p * (1 - p)) + 12
        low, high = max(0, int(size * p - reach)), min(size, int(size * p + reach))
        k = np.arange(low, high)
        log = np.r_[0.0, np.cumsum(np.log(size - k) - np.log(k + 1) + math.log(p) - math.log1p(-p))]
        mass = np.exp(log - log.max())
        out[own] = low + np.searchsorted(np.cumsum(mass) / mass.sum(), u[own], "right").clip(0, len(mass) - 1)
    return out


def node_key(*name: str) -> int:
    return int(hashlib.sha256(":".join(name).encode()).hexdigest()[:8], 16)


def split(n: np.ndarray, left: int, total: int, name: tuple[str, ...], seed: int) -> np.ndarray:
    """How many of the n rows of a node fall to its left child, for each draw."""
    x = numbers(np.arange(len(n)), np.array([node_key(*name)]), seed)[:, 0]
    return binomial(n, left / total, (x + 0.5) / P)


def counts_below(n: np.ndarray, cells: np.ndarray, name: tuple[str, ...], seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(cell, its rows in each draw) for the cells below a node; the left child has the first half of them."""
    open_ = [(0, len(cells), n, name[-1])]
    total = np.r_[0, np.cumsum(cells)]
    while open_:
        lo, hi, rows, path = open_.pop()
        if hi - lo == 1:
            yield lo, rows
            continue
        mid = lo + (hi - lo) // 2
        left = split(rows, int(total[mid] - total[lo]), int(total[hi] - total[lo]), (*name[:-1], path), seed)
        open_ += [(lo, mid, left, path + "L"), (mid, hi, rows - left, path + "R")]


def _paths(cells: DataFrame, key: list[str], depth: int) -> DataFrame:
    """Per block: for each level from the root, the rows of the left child and of the node."""
    blocks = cells.groupBy(*key, "__block").agg(F.sum("__c").alias("__c"))
    out = blocks.select(*key, "__block", F.array().cast("array<struct<left:long,total:long>>").alias("__path"))
    for level in range(depth):
        node = F.shiftright(F.col("__block"), depth - level)
        is_left = F.shiftright(F.col("__block"), depth - level - 1) % 2 == 0
        nodes = blocks.groupBy(*key, node.alias("__node")).agg(F.coalesce(F.sum(F.when(is_left, F.col("__c"))), F.lit(0)).alias("left"), F.sum("__c").alias("total"))
        out = out.withColumn("__node", node).join(nodes, [*key, "__node"]).select(*key, "__block", F.array_append("__path", F.struct("left", "total")).alias("__path"))
    return out


def bootstrap_sums(df: DataFrame, by: list[str], stratum: str, value: str, draws: int = DRAWS, seed: int = 1, block: int = BLOCK, rows: str | None = None) -> DataFrame:
    """(by, draw, s, n): the sum of value over a resample of every stratum of a group, pooled, and its size (that of the group).

    Rows without a value do not count; a null stratum is one of its own, called
    null.  `rows` names a column that says how many rows a row stands for.
    """
    count = F.sum(rows) if rows else F.count("*")
    key = [*by, "__stratum"]
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, F.coalesce(F.col(stratum).cast("string"), F.lit("null")).alias("__stratum"), F.col(value).cast("double").alias("__v")).agg(count.alias("__c")).where("__c > 0")
    most = cells.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(most / block))) if most else 0
    cells = cells.withColumn("__block", F.shiftrightunsigned(F.xxhash64("__v"), 64 - depth) if depth else F.lit(0).cast("long"))
    kinds = [f for f in cells.schema.fields if f.name in by]
    out = T.StructType([*kinds, T.StructField("draw", T.LongType()), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__v")
        size, stratum_, own = pdf["__c"].to_numpy(), pdf["__stratum"].iloc[0], int(pdf["__block"].iloc[0])
        path = list(pdf["__path"].iloc[0])
        rows, name = np.full(draws, path[0]["total"] if path else size.sum(), np.int64), "r"
        for level, step in enumerate(path):
            left = split(rows, step["left"], step["total"], (stratum_, name), seed)
            right = own >> (depth - level - 1) & 1
            rows, name = (rows - left, name + "R") if right else (left, name + "L")
        s, v = np.zeros(draws), pdf["__v"].to_numpy()
        for cell, count in counts_below(rows, size, (stratum_, name), seed):
            s += v[cell] * count
        got = pd.DataFrame({"draw": np.arange(draws), "s": s, "n": int(size.sum())})
        for k in by:
            got[k] = pdf[k].iloc[0]
        return got[out.names]

    parts = cells.join(_paths(cells, key, depth), [*key, "__block"]) if depth else cells.withColumn("__path", F.array().cast("array<struct<left:long,total:long>>"))
    return parts.groupBy(*key, "__block").applyInPandas(run, out).groupBy(*by, "draw").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def bootstrap_means(df: DataFrame, by: list[str], stratum: str, value: str, draws: int = DRAWS, seed: int = 1, block: int = BLOCK, rows: str | None = None) -> DataFrame:
    """(by, draw, m): the pooled mean of a fixed-size resample of every stratum."""
    return bootstrap_sums(df, by, stratum, value, draws, seed, block, rows).select(*by, "draw", (F.col("s") / F.col("n")).alias("m"))


def means_sql(source: str, by: str, stratum: str, value: str, seed: int, draws: int = DRAWS) -> str:
    """Query of (by, draw, m) as `bootstrap_means` gives them, for strata with at most three distinct values."""
    x = scattered_sql(f"(select f_n.*, ('0x' || substr(sha256(stratum || ':' || node), 1, 8))::ubigint::bigint as node_key, draw from f_n, (select unnest(range({draws})) as draw))", "draw", "node_key", seed)
    pick = f"list_count(list_filter(cdf, lambda c: c <= (x + 0.5) / {P}))"
    cdf = "select * exclude (j, mass, upto), list(upto order by j) as cdf from (select *, sum(mass) over (partition by {0}, stratum, trials order by j) as upto from (select *, exp(lgamma(trials + 1) - lgamma(j + 1) - lgamma(trials - j + 1) + j * ln(p) + (trials - j) * ln(1 - p)) as mass from (select *, unnest(range(0, trials + 1)) as j from {1}))) group by all"
    return f"""select {by}, draw, sum(s) / sum(n) as m from (
        with f_c as (select {by}, coalesce({stratum}::varchar, 'null') as stratum, {value}::double as v, count(*) as c from {source} where {value} is not null group by all),
        f_s as (select {by}, stratum, list(v order by v) as v, list(c order by v) as c, sum(c)::bigint as n from f_c group by all),
        f_n as (select *, 'r' as node from f_s), f_x1 as (select {by}, stratum, draw, x from {x}),
        f_t1 as ({cdf.format(by, "(select " + by + ", stratum, n as trials, c[1]::double / n as p from f_s where len(v) > 1)")}),
        f_1 as (select s.*, draw, case when len(v) > 1 then {pick} else n end as n1 from f_s s join f_x1 using ({by}, stratum) left join f_t1 t using ({by}, stratum)),
        f_y as (select * replace ('rR' as node) from f_n), f_x2 as (select {by}, stratum, draw, x from {x.replace("f_n", "f_y")}),
        f_t2 as ({cdf.format(by, "(select distinct " + by + ", stratum, n - n1 as trials, c[2]::double / (c[2] + c[3]) as p from f_1 where len(v) = 3)")}),
        f_2 as (select f.*, case when len(v) = 3 then {pick} else n - n1 end as n2 from f_1 f join f_x2 using ({by}, stratum, draw) left join f_t2 t on t.{by} = f.{by} and t.stratum = f.stratum and t.trials = f.n - f.n1)
        select {by}, stratum, draw, n, v[1] * n1 + coalesce(v[2] * n2, 0) + coalesce(v[3] * (n - n1 - n2), 0) as s from f_2) group by {by}, draw"""

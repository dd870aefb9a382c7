"""Interaction of filters by a subset-zeta transform over mask counts.

A document's mask has a bit for every filter that it fails.  Documents are counted
by part, mask and labels; that is all that leaves the scan.  The zeta transform
turns a part's counts by mask into the survivors of every set of filters: the sum
over all masks that the set does not touch.  A step of an order is then the
difference between two neighbouring sets, for all documents, for good ones and for
toxic ones alike, and the Shapley sum of a filter weighs the same differences by
how many orders pass through them.

Rows that repeat a text are found by its digest and length: the smallest id of each
text comes from a grouped minimum, and only texts that occur under several ids are
joined back.

Defined cases: a null text is empty, a null lang is the part '', a null or absent
label is none; every row is a document of its own; a null id is larger than no id and
no id is larger than it, so such a row never fails E nor makes another one fail;
of several label rows of a document any 1 counts; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import join_hot, stored

WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """The filters that a text alone decides, by letter; true where it fails."""
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < 200, "B": 100 * distinct.cast("long") < 50 * n.cast("long"), "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"), "D": text.rlike("[#$%&*|]")}


def mask_of(filters: dict[str, Column]) -> Column:
    """Bit k for the k-th filter that fails."""
    mask = F.lit(0)
    for k, fails in enumerate(filters.values()):
        mask = mask + F.when(fails, F.lit(1 << k)).otherwise(F.lit(0))
    return mask


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, rows): documents counted by id, part and the set of filters A to E that they fail."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = docs.select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), mask_of(text_filters(text)).alias("mask"),
        F.struct(F.unhex(F.sha2(text, 256)).alias("h"), F.octet_length(text).alias("n")).alias("key"),
    )
    # a row an id, part and text: copies under one id are counted before anything moves
    each = stored(each.groupBy("doc_id", "part", "mask", "key").agg(F.count("*").alias("rows")), "masks")
    ids = each.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("held"))
    several = stored(ids.where(F.col("first") < F.col("last")).select("key", "first", "held"), "copies")
    copies = join_hot(each, several, "key", "held", how="left")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return copies.groupBy("doc_id", "part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask")).agg(F.sum("rows").alias("rows"))


def counted(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a part: (mask, all, good, toxic) for every mask that it has, as an array of at most as many as there are masks."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max((F.coalesce(F.col(k), F.lit(0)) == 1).cast("int")).alias(k) for k in ("quality", "toxic")])
    j = masked.join(known.where("quality = 1 or toxic = 1"), "doc_id", "left")
    n = j.groupBy("part", "mask").agg(F.sum("rows").alias("n"), *[F.sum(F.when(F.col(k) == 1, F.col("rows")).otherwise(0)).alias(k) for k in ("quality", "toxic")])
    return n.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "quality", "toxic")).alias("cells"))


def survivors(counts: np.ndarray) -> np.ndarray:
    """Of counts by mask (last axis): how many no filter of a set removes, by set.

    The zeta transform sums over subsets, one bit after the other; a set's
    survivors are the sum over the subsets of its complement.
    """
    bits = counts.shape[-1].bit_length() - 1
    cube = counts.reshape(*counts.shape[:-1], *[2] * bits).copy()
    for k in range(bits):
        axis = cube.ndim - 1 - k
        np.cumsum(cube, axis=axis, out=cube)
    return cube.reshape(counts.shape)[..., ::-1]


def steps(filters: str) -> list[tuple[str, int, int, int]]:
    """(order, step from 1, index of its filter, set of the filters before it) for every step of every order."""
    out = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, k in enumerate(order, 1):
            out.append(("".join(filters[i] for i in order), step, k, before))
            before |= 1 << k
    return out


def interactions(parts: DataFrame, filters: str) -> DataFrame:
    """The step table of every part: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    n, plan = len(filters), steps(filters)
    letter, before = np.array([p[2] for p in plan]), np.array([p[3] for p in plan])
    after, every = before | 1 << letter, (1 << n) - 1
    sets = np.arange(1 << n)
    size = np.bitwise_count(sets).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 256):
                s = b.slice(first, 256)
                rows = s.num_rows
                cells, row = s.column(1).flatten(), pc.list_parent_indices(s.column(1)).to_numpy()
                counts = np.zeros((3, rows, 1 << n), np.int64)
                for k, name in enumerate(("n", "quality", "toxic")):
                    counts[k, row, cells.field("mask").to_numpy()] = cells.field(name).to_numpy()
                left, good, toxic = survivors(counts)
                failing = left[:, :1] - left[:, 1 << np.arange(n)]
                only = left[:, every ^ (1 << np.arange(n))] - left[:, [every]]
                shapley = np.zeros((rows, n), np.int64)
                for k in range(n):
                    out = sets[sets >> k & 1 == 0]
                    weight = np.array([factorial(i) * factorial(n - 1 - i) for i in size[out]])
                    shapley[:, k] = (left[:, out] - left[:, out | 1 << k]) @ weight
                removed = left[:, before] - left[:, after]
                columns = {
                    "kept": left[:, after], "removed": removed, "redundant": failing[:, letter] - removed, "unique_fails": only[:, letter],
                    "good_lost": good[:, before] - good[:, after], "toxic_lost": toxic[:, before] - toxic[:, after], "shapley": shapley[:, letter],
                }
                yield pa.RecordBatch.from_arrays(
                    [s.column(0).take(pa.array(np.repeat(np.arange(rows), len(plan)))), pa.array([p[0] for p in plan] * rows), pa.array([p[1] for p in plan] * rows, pa.int32()), *[pa.array(v.ravel().astype(np.int64)) for v in columns.values()]],
                    names=["part", "filter_order", "step", *columns],
                )

    return parts.mapInArrow(run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders of the filters A to E over every part of docs."""
    return interactions(counted(masks(docs), labels), "ABCDE")

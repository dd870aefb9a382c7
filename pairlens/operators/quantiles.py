"""Exact order statistics and quantiles of groups of any size.

Equal values are counted once; then ranks are looked for by narrowing.  A group
with too many distinct values for one task is cut into ranges at approximate
quantiles, the counts of the ranges say in which one a rank lies, and only those
ranges go on.  What is left fits a task, which walks the running counts.  The cuts
only decide how the work is spread: whatever they are, the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.operators.durable import kept

#: Distinct values that a task walks, and ranges that a larger group is cut into.
LIMIT, RANGES = 100_000, 200
#: Cuts (numbers) up to which they are broadcast.
CUTS = 2_000_000


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column], limit: int = LIMIT, ranges: int = RANGES) -> DataFrame:
    """One row a group (null is a group): by, n, and for each name the value of that rank (from 0), null where there is none.

    ranks: columns over `n`, the number of the group's rows that have a value.
    """
    own = df.where(F.col(value).isNotNull()).select(F.struct(F.lit(1).alias("__one"), *by).alias("__g"), F.col(value).alias("__v"))
    cells = kept(own.groupBy("__g", "__v").agg(F.count("*").alias("__c")), "cells")
    groups = kept(cells.groupBy("__g").agg(F.sum("__c").alias("n")), "groups")
    wanted = groups.select("__g", "n", F.explode(F.create_map(*[x for k, c in ranks.items() for x in (F.lit(k), c.cast("long"))])).alias("__name", "__rank"))
    wanted = wanted.where((F.col("__rank") >= 0) & (F.col("__rank") < F.col("n"))).select("__g", "__name", "__rank", F.lit("").alias("__path"))
    key, open_ = ["__g", "__path"], cells.withColumn("__path", F.lit(""))
    while True:
        large = open_.groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") > limit)
        if large.isEmpty():
            break
        cuts = large.select(*key).join(open_, key).groupBy(*key).agg(F.percentile_approx("__v", [k / ranges for k in range(1, ranges)], 4 * ranges).alias("__cuts"))
        cuts = kept(cuts, "cuts")
        few = cuts.count() * ranges <= CUTS
        cut = open_.join(F.broadcast(cuts) if few else cuts, key, "left")
        cut = cut.withColumn("__part", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__v"))), F.lit(0))).drop("__cuts")
        counts = cut.groupBy(*key, "__part").agg(F.sum("__c").alias("__c"))
        upto = F.sum("__c").over(Window.partitionBy(*key).orderBy("__part"))
        counts = counts.select(*key, "__part", (upto - F.col("__c")).alias("__before"), upto.alias("__upto"))
        path = F.concat_ws("/", "__path", F.col("__part").cast("string"))
        wanted = wanted.join(counts, key).where((F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__upto")))
        wanted = kept(wanted.select("__g", "__name", (F.col("__rank") - F.col("__before")).alias("__rank"), path.alias("__path")), "wanted")
        hit = wanted.select(*key).distinct()
        narrowed = cut.select("__g", path.alias("__path"), "__v", "__c")
        open_ = kept(narrowed.join(F.broadcast(hit) if few else hit, key, "left_semi"), "open")
    upto = F.sum("__c").over(Window.partitionBy(*key).orderBy("__v"))
    walked = open_.select(*key, "__v", (upto - F.col("__c")).alias("__before"), upto.alias("__upto"))
    found = walked.join(wanted, key).where((F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__upto")))
    wide = found.groupBy("__g").agg(*[F.max(F.when(F.col("__name") == k, F.col("__v"))).alias(k) for k in ranks])
    return groups.join(wide, "__g", "left").select(*[F.col(f"__g.{b}").alias(b) for b in by], "n", *ranks)


def quantiles(df: DataFrame, by: list[str], value: str, rules: dict[str, tuple[float, str] | str], limit: int = LIMIT) -> DataFrame:
    """One row a group: by, n and a quantile for each rule.

    A rule is (q, "linear"): between the two neighbours of q (n - 1); (q, "nearest"):
    the value at the rounded place, halves to even; or "index:k": the value of rank k.
    """
    n, ranks = F.col("n"), {}
    for name, rule in rules.items():
        if isinstance(rule, str):
            ranks[name] = F.lit(int(rule.removeprefix("index:")))
        elif rule[1] == "nearest":
            ranks[name] = F.bround(rule[0] * (n - 1))
        else:
            ranks |= {f"__low_{name}": F.floor(rule[0] * (n - 1)), f"__high_{name}": F.ceil(rule[0] * (n - 1))}
    s = order_statistics(df, by, value, ranks, limit)
    out = []
    for name, rule in rules.items():
        if isinstance(rule, str) or rule[1] == "nearest":
            out.append(F.col(name).cast("double").alias(name))
        else:
            low, high, at = F.col(f"__low_{name}").cast("double"), F.col(f"__high_{name}").cast("double"), rule[0] * (n - 1)
            out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return s.select(*by, "n", *out)
